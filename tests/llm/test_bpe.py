import hashlib
import random

import pytest
import tiktoken

from orrery.llm import bpe


@pytest.fixture(scope="module")
def model():
    path, pattern = bpe.default_ranks()
    assert pattern == bpe.PUBLIC_PATTERN
    ranks = bpe.read_ranks(path)
    return bpe.MergeReplay(ranks, pattern), tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_equal_the_library(model):
    replay, library = model
    rng = random.Random(3)
    letters = "aaabeth  \n\t'sdé日🙂.,!1 ½²_  \x1f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 500, "<|endoftext|>", "ab" * 999, None]
    for text, ids in zip(texts, replay.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert replay.decode(ids).tobytes() == (text or "").encode()


def test_long_text_in_runs(model, monkeypatch):
    replay, library = model
    text = "The threes, anding 12 ünd\n " * 400
    monkeypatch.setattr(bpe, "SLICE_CHARS", 500)
    assert replay.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_documents(spark, model):
    _, library = model
    rows = [(1, "Hello there, hello!"), (2, None), (3, ""), (1, "Hello there, hello!"), (None, "x y")]
    df = spark.createDataFrame([(a, b, b) for a, b in rows], "doc_id long, text string, ids string")
    got = bpe.digests(bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id"), "doc_id").collect()
    want = []
    for key, text in rows:
        ids = library.encode_ordinary(text or "")
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((key, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").count() == 0
