import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import mixing


def plan(spark, blocks, weights):
    """Phases, and each one's sources in the order of its slots; every slot is taken, and every source's blocks come in order."""
    phases = list(mixing.phases(blocks, weights))
    rows = sorted(mixing.planned(spark, iter(phases)).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(sum(blocks)))
    done, order = [0] * len(blocks), {}
    for r in rows:
        assert r["block"] == done[r["source"]]
        done[r["source"]] += 1
        order.setdefault(r["phase"], []).append(r["source"])
    assert done == list(blocks) and [len(order[p.phase]) for p in phases] == [p.length for p in phases]
    return phases, order


def assert_close(phases, order, every=1):
    """In every prefix of every phase each source is less than one block off, by whole numbers."""
    for p in phases:
        taken = dict.fromkeys(p.sources, 0)
        for n, s in enumerate(order[p.phase], 1):
            taken[s] += 1
            if n % every == 0:
                assert all(abs(taken[q] * mixing.PRECISION - n * c) < mixing.PRECISION for q, c in zip(p.sources, p.parts, strict=True))


@pytest.mark.parametrize(("chunk", "most"), [(3, 9), (1, 50), (8, 400), (128, 4_000)])
def test_less_than_one_block_off(spark, monkeypatch, chunk, most):
    # Low bounds: windows that reach over borders, and phases that are planned in turn.
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", chunk)
    monkeypatch.setattr(mixing, "MOST_CHUNK_SLOTS", most)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 100)
    draw = random.Random(chunk)
    for _ in range(4):
        blocks = [9, *(draw.choice([0, 1, 3, 40, 200]) for _ in range(draw.randint(1, 25)))]
        assert_close(*plan(spark, blocks, [draw.choice([0.0, 0.01, 0.1, 1.0, 2.5, 7.0]) for _ in blocks]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=12), st.integers(1, 3000))
def test_blocks_before_a_border(weights, border):
    parts = mixing.quantise([float(w) for w in weights], mixing.PRECISION)
    before = mixing._ahead(parts, border)
    assert sum(before) == border and sum(parts) == mixing.PRECISION
    assert all(abs(n * mixing.PRECISION - border * c) < mixing.PRECISION for n, c in zip(before, parts, strict=True))


def test_thousands_of_sources(spark):
    blocks = [1 + i % 3 for i in range(2_500)]
    phases, order = plan(spark, blocks, [1.0] * 2_500)
    assert len(phases) < 10


def test_quantise():
    assert mixing.quantise([1.0, 1.0, 2.0], 8) == [2, 2, 4]
    assert sum(mixing.quantise([1e-9, 1.0, 3.3], 50)) == 50
    assert min(mixing.quantise([1e-9, 1.0, 3.3], 50)) == 1


def test_schedule(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}", i) for i in range(1200)] + [(None, None, None, 1), (5, "t", "hot", 2), (5, "t", "hot", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_place long")
    got = mixing.schedule(df, {"hot": 1.0, "s0": 1.0, "s1": 0.5}, block_rows=4)
    out = got.orderBy("mix_place").collect()
    assert len(out) == len(rows) and len({r["mix_place"] for r in out}) == len(rows)
    blocks = {}
    for r in out:
        blocks.setdefault(r["mix_slot"], set()).add((r["source"], r["mix_block"]))
    assert all(len(v) == 1 for v in blocks.values())
    first = [next(iter(blocks[s]))[0] for s in range(40)]
    for t in range(1, 41):
        for source, w in (("hot", 0.4), ("s0", 0.4), ("s1", 0.2)):
            assert abs(first[:t].count(source) - w * t) < 1.01
    assert mixing.mixed(df).count() == len(rows) and mixing.mixed(df).columns == df.columns
    assert mixing.schedule(df.limit(0)).count() == 0
    plan = mixing.mixed(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_exact_weights_over_a_long_phase(spark):
    # One source with a third of the rows, 19 equal others: the rounding of weights must not add up.
    blocks = [30_000, *[3_158] * 19]
    weights = [n**0.5 for n in blocks]
    phases, order = plan(spark, blocks, weights)
    total, taken = sum(weights), [0] * len(blocks)
    assert len(order[0]) > 20_000
    for t, s in enumerate(order[0], 1):
        taken[s] += 1
        assert all(abs(n - t * w / total) < 1 + 1e-6 for n, w in zip(taken, weights, strict=True))


def test_slots_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_NUMBERS", 20)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    sent = mixing.schedule(df, block_rows=4, period=8).collect()
    monkeypatch.setattr(mixing, "SEND_BLOCKS", 0)
    monkeypatch.setattr(mixing, "SEND_SOURCES", 0)
    assert sorted(sent) == sorted(mixing.schedule(df, block_rows=4, period=8).collect())
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    names = sorted(sizes)
    _, order = plan(spark, [-(-sizes[s] // 4) for s in names], [sizes[s] ** 0.5 for s in names])
    slots = {r["mix_slot"]: (r["mix_phase"], r["source"]) for r in sent}
    assert [slots[i] for i in range(len(slots))] == [(p, names[s]) for p in sorted(order) for s in order[p]]


def test_errors(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": -1.0})
    with pytest.raises(ValueError):
        mixing.schedule(df, block_rows=0)


def test_other_columns_come_back(spark):
    names = ["known", "name", "chunk", "slots", "phases", "rank", "run", "runs", "start", "shards", "n", "s", "mix_shard", "mix_source", "mix_row", "mix_known", "mix_name"]
    rows = [(i, f"s{i % 3}", *[f"{c}{i}" for c in names]) for i in range(200)]
    df = spark.createDataFrame(rows, ["doc_id", "source", *names])
    got = mixing.schedule(df, block_rows=4)
    assert got.columns == [*df.columns, *mixing.ADDED]
    assert sorted(tuple(r)[: len(df.columns)] for r in got.collect()) == sorted(rows)
    assert sorted(map(tuple, mixing.mixed(df).collect())) == sorted(rows)
    again = mixing.mixed(got)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect())) and again.columns == got.columns


def test_irrational_weights_over_many_blocks(spark):
    phases, order = plan(spark, [350_000, 205_000, 45_001, 3], [2**0.5, 3**0.5, 0.1 * 5**0.5, 1e-5])
    assert len(order[0]) > 300_000
    assert_close(phases, order, 7)
