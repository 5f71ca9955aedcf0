import hashlib
import random
import re

import pytest

from orrery.llm import decontaminate as D

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(docs, items, size=10):
    """Every place of every document against every window."""
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as words", "1 as window", "2 as h")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as items", "3 as n")
    out = D.decontaminate(d, b, **more)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, out.collect()), key=str)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["a", "B", "é", "7", "zz", "É"]) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 8, 10, 11, 14]))) for i in range(12)]
    docs = [(i, some(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{some(5)} {text.upper() if i % 2 else text} -- {some(4)}, {text}") for i, (_, text) in enumerate(items)]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, shared), (2, "Zero " + shared), (3, shared.upper()), (None, "alpha beta"), (4, None), (5, ""), (6, ".,"), (1, "gamma"), (10, shared)]
    docs = [
        (1, shared), (1, shared), (1, "x"), (None, shared + " gamma"), (2, None), (3, ""), (4, "!!"), (5, "ALPHA, beta! gammas"),
        (6, "one two three four five six seven eight nine"), (7, (shared + " ") * 300), (8, "ten eleven twelve one two " * 3), (9, "word " * 30_000 + shared),
    ]
    assert run(spark, docs, items) == brute(docs, items)


def test_windows_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(15))) for i in range(30)]
    docs = [(i, " ".join(items[rng.randint(0, 29)][1] for _ in range(3))) for i in range(20)]
    monkeypatch.setattr(D, "BLOCK_ROWS", 40)
    monkeypatch.setattr(D, "SEND_SETS", 0)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_parameters(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])
    assert run(spark, [(1, "a b c")], [(1, "b c"), (2, "d")], window=2, shingle=1) == brute([(1, "a b c")], [(1, "b c"), (2, "d")], 2)
    with pytest.raises(ValueError):
        run(spark, [], [], window=3)


def test_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for df in (D.decontaminate(d, b), D._placed(d.select("doc_id", D.words_of(d.text).alias("words")).selectExpr("*", "size(words) as n_words"), [1, 5], True)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
