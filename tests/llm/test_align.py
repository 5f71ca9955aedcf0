import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orrery.llm import align as A


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(library, text):
    """The ids and ends of both sides by the libraries themselves, None if there are none."""
    if not text:
        return None
    a, b = library
    whole = (" " + text).encode()
    units = A.byte_level()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(units[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [A.piece_bytes(b.id_to_piece(i)) for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return [(ids, np.cumsum([len(x) for x in raw]).tolist()) for ids, raw in ((ids_a, bytes_a), (ids_b, bytes_b))]


def brute(library, docs):
    parts, held = [], Counter()
    for doc, text in docs:
        found, groups = tokens(library, text), []
        if found:
            (a, ea), (b, eb) = found
            both, x, y, j = set(ea) & set(eb), [], [], 0
            for i, end in zip(a, ea, strict=True):
                x.append(i)
                if end in both:
                    while j < len(b) and eb[j] <= end:
                        y.append(b[j])
                        j += 1
                    groups.append((x, y))
                    x, y = [], []
        links = [(i, j) for x, y in groups for i in x for j in y]
        held.update(set(links))
        parts.append((doc, groups, links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for doc, groups, links in parts:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as rid", "2 as key")
    out = A.align(df, **more)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["the", "The", " ", "  ", "\n", "\t", " \n ", "thing", "tion", "'s", "é", "日本", "🙂", "\x00", "\x1c", "\xa0", "1999", "--", "aaaaaaaa", "ñ", "<|endoftext|>", "<s>", "ﬁ", "é", "<0x0A>", ","]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_words_give_the_library_s_ids(library):
    model = A.Encoder(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert model.cuts
    some = [*texts(1500), "", None, "x▁y", "▁", " ", "   a", "a" * 3000, " " * 500, "<unk> a"]
    for text, got in zip(some, model.encode(some), strict=True):
        want = tokens(library, text)
        assert (got is None) == (want is None), text
        assert want is None or [x.tolist() for x in got] == [x[0] for x in want], text
    model.cuts = False
    model.forget()
    assert [x and x[1].tolist() for x in model.encode(some[:50])] == [w and w[1][0] for w in (tokens(library, t) for t in some[:50])]


def test_documents_equal_brute_force(spark, library):
    docs = [(i, t) for i, t in enumerate(texts(120, 2))]
    docs += [(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (3, ""), (4, "a▁b"), (5, "the thing " * 3000)]
    assert run(spark, docs) == brute(library, docs)
    # Every pair, or all but the commonest, by the join.
    assert run(spark, docs, send_pairs=0) == run(spark, docs, send_pairs=40) == brute(library, docs)


def test_chunks_and_open_groups(library, monkeypatch):
    """Rows arrive in small pieces; a group and a document may go on over many."""
    model = A.Encoder(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    some = [t for t in [*texts(40, 3), "日本語🙂" * 60, "aaaaaaa" * 90] if tokens(library, t)]
    sizes = tuple(s.size for s in model.sides)
    machine, got = A.Machine(sizes), []
    rows = []
    for rid, ids in enumerate(model.encode(some)):
        for side in (0, 1):
            ends = np.cumsum(sizes[side][ids[side]])
            for i in range(0, len(ids[side]), 7):
                rows.append((rid, rid, side, int(ends[i - 1]) if i else 0, int(ends[-1]), ids[side][i : i + 7]))
    rows.sort(key=lambda r: (r[0], r[3], r[2]))
    for i in range(0, len(rows), 3):
        got += machine.add(rows[i : i + 3])
    assert not machine.docs and machine.open is None and not len(machine.ids[0]) and not len(machine.ids[1])
    want = {r[0]: r for r in brute(library, list(enumerate(some)))}
    assert len(got) == len(some)
    for doc, _, a, b, groups, links, sha, pairs, times in got:
        assert (a, b, groups, links, sha) == (*want[doc][1:5], want[doc][7])
        assert sum(np.frombuffer(times, "<u4")) == links and len(pairs) == 2 * len(times)


def test_long_text(spark, library, monkeypatch):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "bêta", "日本", "thing", "the"]) for _ in range(100_000))
    docs = [(1, long), (2, "the thing")]
    assert run(spark, docs) == brute(library, docs)


def test_empty_table(spark):
    assert run(spark, []) == []
