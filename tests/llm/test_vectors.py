import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, topk, vectors


def table(spark, n=700, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:120] = x[50]  # copies tie
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(n, None), (n + 1, [0.0] * d), (n + 2, [None] + [1.0] * (d - 1)), (n + 3, [math.nan] * d), (n + 4, [math.inf] * d), (n + 5, [1.0]), (None, [1.0] * d)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(3)).withColumn("v", F.lit(4))


def brute_force(rows, step, k, score, d=12, zero=False):
    ok = [(i, v) for i, v in rows if i is not None and v and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    want = {}
    for q, a in ok:
        if q % step == 0:
            found = sorted(((score(a, b), -i) for i, b in ok if i != q), reverse=True)[:k]
            want.update({(q, r): (-i, s) for r, (s, i) in enumerate(found, 1)})
    return want


@pytest.mark.parametrize("small_tiles", [False, True])
def test_nearest(spark, monkeypatch, small_tiles):
    if small_tiles:
        monkeypatch.setattr(vectors, "TILE_QUERIES", 7)
        monkeypatch.setattr(vectors, "TILE_VECTORS", 90)
    rows, df = table(spark)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, ann.every_nth(20)).collect()}
    want = brute_force(rows, 20, 20, lambda a, b: float(np.dot(np.float64(a), np.float64(b))))
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][1] == pytest.approx(want[key][1], abs=1e-9)
    assert sum(got[key][0] != want[key][0] for key in want) <= len(want) * 0.001


@pytest.mark.parametrize("small_tiles", [False, True])
def test_exact_top(spark, monkeypatch, small_tiles):
    if small_tiles:
        monkeypatch.setattr(vectors, "TILE_QUERIES", 5)
        monkeypatch.setattr(vectors, "TILE_VECTORS", 60)
    rows, df = table(spark, seed=2)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top(df, ann.every_nth(50)).collect()}
    whole = lambda v: [math.floor(256 * float(x)) for x in v]
    want = brute_force(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)), zero=True)
    assert got == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, ann.every_nth(20)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 20), (0, 3, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.nearest(df.limit(0), ann.every_nth(20)).count() == 0
    assert topk.exact_top(df.limit(0), ann.every_nth(50)).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(df, ann.every_nth(20), k=0)


def test_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 9.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1e200, 1e200]), (4, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(df, ann.every_nth(20)).orderBy("rank").collect()]
    assert got == [(3, 0.5e200 + 9e200), (2, 9.0), (1, 0.5), (4, 0.5e-200)]
    whole = [(r["vec_id"], r["score"]) for r in topk.exact_top(df.filter("vec_id < 3"), ann.every_nth(50)).orderBy("rank").collect()]
    assert whole == [(2, 9 * 256 * 256), (1, 128 * 256)]


def test_exact_beyond_doubles(spark):
    whole = lambda v: [int(256 * x) if abs(x) > 2**45 else math.floor(256 * x) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True))
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=3) * 10.0 ** rng.integers(0, 4)]) for i in range(1, 120) if i not in (50, 100)]
    rows += [(0, [1.0, 2.0, 0.0]), (150, [0.0, 1e6, 0.0]), (200, [-1e17, -1e17, 0.0]), (201, [3e12, -3e12, 0.001])]
    rows += [(203, [1e10, 1e3, 0.0]), (250, [1e6, 1e6 + 1, 0.0]), (300, [0.0, 0.0, 1e15]), (301, [0.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {q: sorted(((dot(a, b), -i) for i, b in rows if i != q), reverse=True)[:5] for q, a in rows if q % 50 == 0}
    fits = {q for q, found in best.items() if all(abs(s) < 2**63 for s, _ in found)}
    assert fits == {0, 150} and len(best) == 5
    fitting = topk.exact_top(df, F.col("id").isin(*fits)).collect()
    assert {(r["query_id"], r["rank"]): (r["score"], -r["vec_id"]) for r in fitting} == {(q, n): x for q in fits for n, x in enumerate(best[q], 1)}
    with pytest.raises(Exception, match="does not fit a long"):
        topk.exact_top(df, ann.every_nth(50)).collect()
    with pytest.raises(Exception, match="not finite"):
        topk.exact_top(spark.createDataFrame([(0, [1e307]), (1, [1.0])], df.schema), ann.every_nth(50)).collect()
