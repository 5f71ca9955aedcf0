import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import jaccard


def shingle_set(text):
    words = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return {key: (least[root(i)], links[i]) for i, (key, _) in enumerate(rows)}


def corpus(seed, groups=25, hot=70):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(300)]
    texts = []
    common = " ".join(rng.choices(vocabulary, k=9))
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(hot if g == 0 else rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            texts.append(text.title() + "!" if rng.random() < 0.2 else text)
        texts.append(" ".join(rng.choices(vocabulary, k=30)) + "\n" + common)
    rng.shuffle(texts)
    return list(enumerate([*texts, "", "one two", "One, two?"], 10))


@pytest.mark.parametrize("settings", [{}, {"BUCKET": 4, "BLOCK": 16, "DEPTH": 3}])
def test_equals_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(4)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_force(rows)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want


def test_shingles_equal_the_words(spark):
    texts = ["Hello, wörld! one-two three  four", "a", "", None, "x " * 40, "tab\tand\nline 1 2 3"]
    hashes, counts = jaccard.word_hashes(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert n == len(re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()))
        assert len(jaccard.shingles(hashes[at : at + n])) == len(shingle_set(text))
        at += n


def test_edge_cases(spark):
    rows = [(1, "a b c d e f g", "k"), (None, "a b c d e f g", "k"), (3, None, "k"), (4, "", "k"), (1, "a b c d e f g", "k"), (5, "A b c, d e f g.", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (5, 1, 2), (3, 3, 0), (4, 4, 0), (None, None, 0)], key=str)
    kept = jaccard.one_of_each(df)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, None], key=str)
    assert kept.columns == df.columns
    assert jaccard.join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.join(df, similarity=0.0)
    assert jaccard.runs_for(0.999) >= jaccard.runs_for(0.9) >= 1


def test_components(spark):
    from orrery.llm.graph import components

    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100 and 200 not in got
    # A hub with most links, by broadcast, and pairs, by shuffle.
    links = [(5, 10 + i) for i in range(3000)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 4001 and all(root == (5 if node < 10_000 else node - node % 2) for node, root in got.items())
    assert components(spark.createDataFrame([], "a long, b long").withColumn("x", F.lit(1))).count() == 0


def test_rows_that_share_an_id(spark, monkeypatch):
    a, b, c = "one two three four five six seven", "a wholly other text about something else", "and a third text that nobody has copied yet"
    rows = [(1, b, "x"), (2, a, "x"), (2, b, "x"), (2, a, "x"), (3, c, "x"), (3, "", "x"), (3, None, "y"), (4, a.upper(), "x"), (None, a, "z"), (None, a, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for few in (jaccard.SEND_IDS, 0):
        monkeypatch.setattr(jaccard, "SEND_IDS", few)
        got = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=str)
        # Both texts of id 2 are judged by themselves: the first of its class stays, the copy of id 1 goes.
        assert got == sorted([(1, b, "x"), (2, a, "x"), (3, c, "x"), (3, "", "x"), (3, None, "y"), (None, a, "z"), (None, a, "z")], key=str)


def test_very_long_text_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    long = " ".join(f"w{i * i % 90_001}" for i in range(250_000))
    rows = [(0, long), (1, long + " end")] + [(2 + i, "the same short text of eight words again") for i in range(40)] + [(100 + i, f"text {i} stands alone with word number {i * 7}") for i in range(20)]
    got = {r["doc_id"]: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert got[0]["class_id"] == got[1]["class_id"] == 0 and got[1]["n_links"] == 1
    assert all(got[2 + i]["class_id"] == 2 and got[2 + i]["n_copies"] == 39 for i in range(40))
    assert all(got[100 + i]["n_links"] == 0 for i in range(20))


def test_recall_of_isolated_pairs_at_the_threshold(spark):
    rng, rows = random.Random(1), []
    for i in range(3_000):
        words = [f"{rng.getrandbits(40):x}" for _ in range(49)]
        rows.append((2 * i, " ".join(words)))
        words[24] = f"changed{i}"
        rows.append((2 * i + 1, " ".join(words)))  # 40 of 50 shingles are shared
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert jaccard.join(df).filter("n_links = 1").count() >= 0.999 * len(rows)


def test_a_group_of_near_copies_is_settled_at_its_first_node(spark, monkeypatch):
    """Copies of one text go on to few nodes below the first, and still all links are found."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(200, 2, replace=False):
            words[k] = f"x{i}y{k}"
        docs.append((i, " ".join(words)))
    met, staged = [], jaccard.staged

    def count(df, label):
        out = staged(df, label)
        if label.startswith("met"):
            met.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", count)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = jaccard.join(df).collect()
    assert sum(met[1:]) < met[0] / 2
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in docs]
    want = [sum(len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) - 1 for a in sets]
    assert [r.n_links for r in sorted(rows)] == want


def test_what_is_near_a_settled_copy_is_a_candidate_with_the_representative(spark):
    from orrery.llm.common import fnv_mix

    runs = jaccard.runs_for(jaccard.RECALL)
    nodes = np.array([r[0] for r in spark.range(1, runs + 1).select(F.xxhash64(F.lit("run"), F.col("id").cast("int"))).collect()], np.int64).astype(np.uint64)
    order = fnv_mix(fnv_mix(nodes[:, None], 3) + np.arange(jaccard.SKETCH, dtype=np.uint64)[None, :], 4)
    chosen = np.unique(np.argpartition(order, jaccard.BRANCHES - 1, axis=1)[:, : jaccard.BRANCHES])
    others = np.setdiff1d(np.arange(jaccard.SKETCH), chosen)
    rep = np.arange(1_000, 1_064, dtype=np.uint32)
    copy, text = rep.copy(), np.arange(9_000, 9_064, dtype=np.uint32)
    copy[others[:16]] += 500  # agrees with the representative in 48 places of 64
    text[chosen], text[others[:16]] = rep[chosen], copy[others[:16]]
    text[others[16 : 32 - len(chosen)]] = rep[others[16 : 32 - len(chosen)]]
    assert (text == copy).mean() == 0.5 and (text == rep).mean() == 0.25
    rows = [(b"\0", rep), (b"\1", copy), (b"\2", text)]
    for i in range(40):
        filler = np.arange(64, dtype=np.uint32) + 100_000 * (i + 1)
        filler[chosen] = rep[chosen]
        rows.append((bytes([3, i]), filler))
    texts = spark.createDataFrame([(k, s.tobytes()) for k, s in rows], "key binary, sketch binary")
    links = {frozenset((bytes(r.a), bytes(r.b))) for r in jaccard.candidates(texts).collect()}
    assert frozenset((b"\0", b"\1")) in links and links & {frozenset((b"\0", b"\2")), frozenset((b"\1", b"\2"))}


def test_small_tables_have_few_tasks(spark):
    from orrery.llm.graph import TASKS, components, small, spread_join

    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(i, i + 1 + i % 2) for i in range(0, 90, 3)], "a long, b long")
        values = links.groupBy("a").agg(F.count("*").alias("n"))
        assert spread_join(links, values, "a", "n").rdd.getNumPartitions() <= TASKS
        assert components(links).rdd.getNumPartitions() <= TASKS
        # A large one keeps a task for each TASK_ROWS rows.
        assert small(spark.range(0, 100, 1, 64), 20_000 * 40).rdd.getNumPartitions() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sides", [0, 1, 2])
def test_a_block_counts_what_lies_across(sides):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 60, (3, 60)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.03, rng.integers(0, 1 << 60, 60).astype(np.uint64), base[i % 3])) for i in range(40)]
    side, copies = (rng.random(40) < 0.5) & (sides == 2) | (sides == 1), rng.integers(1, 5, 40)
    links, behind, joins = jaccard._compare([bytes([i]) for i in range(40)], copies, sets, side, 0.8)
    near = np.array([[i != j and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    near &= (side[:, None] != side[None, :]) | (sides != 2)
    assert near.any() and links.tolist() == near.sum(1).tolist() and behind.tolist() == (near @ copies).tolist()
    assert all(near[i, j] for i, j in joins)


def test_large_groups_are_dealt_in_few_blocks_and_long_texts_in_more(spark, monkeypatch):
    dealt = []
    real = jaccard._verified

    def seen(members, similarity):
        dealt.append(members.groupBy("key").count().agg(F.max("count")).first()[0])
        return real(members, similarity)

    monkeypatch.setattr(jaccard, "_verified", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"own{i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, 0, 599) for i in range(600)}
    for most in (1_000_000, 10_000):
        monkeypatch.setattr(jaccard, "BLOCK_WORDS", most)
        assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(df).collect()} == want
    assert dealt == [2, 4]


def test_rounds_do_not_count_rows_that_are_known(spark, monkeypatch):
    from orrery.llm.graph import components, spread_join

    rows = spark.range(0, 300, 1, 4).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    values = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least"))
    counted = []
    count = type(rows).count
    monkeypatch.setattr(type(rows), "count", lambda self: counted.append(1) or count(self))
    same = lambda many: sorted(spread_join(rows, values, "a", "n", many=many).collect())
    expected = same(None)
    assert counted and len(expected) == 300
    counted.clear()
    assert same(300) == expected == same(1_000_000) and not counted
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) and len(counted) == 1
