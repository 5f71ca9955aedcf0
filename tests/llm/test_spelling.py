import random
import re
import zlib
from collections import Counter

import pytest

from orrery.llm import spelling as S

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    out, form = [], {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out.append([w, len(close)])
    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n[w], k, n.get(form[w])) for w, k in out], key=str)


def run(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "'k' as key")
    out = S.variants(d)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=str)


def table(rng, words):
    """Texts in which the i-th word occurs about 5 * 5 ** (i % 4) times."""
    bag = [w for i, w in enumerate(words) for _ in range(5 * 5 ** (i % 4))]
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::50])) for i in range(50)]


def test_chains_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["wander", "wanders", "wandert", "xanders", "andersx", "Éclair", "éclair", "éclairs", "wednar", "a×b÷cdef", "strasse", "straße"]
    docs = table(rng, words) + [(None, None), (3, ""), (4, "Wander WANDER " * 9), (4, "Wander WANDER " * 9), (None, "wander " * 400)]
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("crowd", [64, 3, 0])
def test_anagrams_of_few_letters(spark, monkeypatch, crowd):
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(90)}
    docs = table(rng, sorted(words))
    monkeypatch.setattr(S.near_pairs, "__defaults__", (crowd,))
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize("crowd", [64, 0])
def test_long_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(S.near_pairs, "__defaults__", (crowd,))
    monkeypatch.setattr(S, "LONG", 9)
    rng = random.Random(9)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 12))) for _ in range(60)} | {"q" * 3000, "q" * 3001, "q" * 1500 + "z" + "q" * 1500}
    docs = table(rng, sorted(words))
    assert run(spark, docs) == brute(docs)


def test_empty_and_parameters(spark):
    assert run(spark, []) == [] and run(spark, [(1, "ab cd"), (2, None)]) == []
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], "doc_id long, text string"), factor=1)


def test_anagram_value(spark):
    df = spark.createDataFrame([("listen",), ("silent",), ("silens",)], "word string")
    own = {r.word: r.key for r in S.keys(df).filter("cut = ''").collect()}
    assert own["listen"] == own["silent"] == sum(ord(c) ** 5 for c in "listen") % ((1 << 61) - 1)
    assert own["silent"] - own["silens"] == ord("t") ** 5 - ord("s") ** 5
