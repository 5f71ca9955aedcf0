"""Alignment of two tokenizers by an event sweep.

A text is encoded by a byte-level BPE (A, of space + text) and by a piece model (B, which
adds the space itself). Every token is an event: its end, a byte offset. Documents are
read once; their events leave the encoder in chunks of about ``CHUNK_BYTES`` of text, a row
a side and chunk, whose ids tell the ends, for a token's bytes follow from its id. The two
sides' rows are united, repartitioned by document and sorted by offset, and each partition
streams through a machine that keeps only what lies behind the last offset at which both
sides end: the open group. A group is what lies between two common ends. Its links are all
pairs of an A and a B token in it.

A machine's state: the open group and the rest of a chunk, and for a document that isn't
finished its running digest and its distinct pairs of ids so far.

How often a pair counts (documents that hold it linked) is added up in each task before
it is shuffled. Of the counted pairs the commonest, ``SEND_PAIRS`` at most, are sent to the
tasks; documents' other pairs meet their counts in a join.

Distinct words are encoded once a worker: where neither vocabulary has a token that
goes on after a space, a text may be cut before a space that follows no white space
(``Encoder.cuts`` tells; else texts are encoded whole). A bounded cache keeps the ids.

Defined results: null and empty texts, and texts whose tokens' joined bytes differ from
space + text, have no tokens: zeros and the digest ''. A null document id stays null; each row of
a repeated id or of a repeated text is a document of its own; an empty table gives an empty
table; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.bpe import runs_by_chars, spread
from orrery.llm.common import release, ship_code, staged, unique_key, worker_cache

#: Bytes of text behind one row of events.
CHUNK_BYTES = 1 << 18
#: Distinct words that a worker keeps before it starts a new cache.
CACHE_WORDS = 400_000
#: Tokens that the machine sweeps at once.
SWEEP_TOKENS = 1_000_000
#: Counted pairs that are sent to every task, some 17 bytes each.
SEND_PAIRS = 3_000_000
#: Pairs that a task adds up before it passes them on.
COUNT_PAIRS = 4_000_000

#: Up to the next space that follows no white space.
_SEGMENT = re.compile(r"\s*+(?:\S++(?:(?! )\s++)?+)*+")


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    """A piece's text: ``<0xHH>`` is a byte, U+2581 a space."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-Fa-f]{2}>", piece) else piece.replace("▁", " ").encode()


class Side:
    """One vocabulary: each id's bytes, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return spread(self.flat, self.start[ids], self.size[ids]).tobytes()


class Encoder:
    """Both tokenizers, and the words met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        units = byte_level()
        tokens = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            tokens[i] = bytes(units[c] for c in token) if all(c in units for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.sides = Side(tokens), Side([piece_bytes(p) for p in pieces])
        before = json.loads(self.a.to_str())
        level = before.get("pre_tokenizer") or {}
        self.cuts = (
            level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and before.get("normalizer") is None
            and not any(re.search("[^▁]▁", p) for p in pieces) and self.b.encode("x", out_type=str)[0][0] == "▁"
            and self.b.encode("x  ﬁ y", out_type=str) != self.b.encode("x fi y", out_type=str)
        )
        self.last_space = self.b.encode("x ")[len(self.b.encode("x")) :]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.empty(0, np.uint16), np.empty(0, np.uint16)]
        self.start = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.count = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.same = np.empty(0, bool)

    def learn(self, words: list[str]) -> None:
        """Encodes words not met before; all begin with a space."""
        raw = [w.encode() for w in words]
        found = [e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)], self.b.encode([w[1:] for w in words], num_threads=1)
        if " " in words:  # the last space of a text, to which the model adds none
            found[1][words.index(" ")] = self.last_space
        same = np.ones(len(words), bool)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        for k, (side, ids) in enumerate(zip(self.sides, found, strict=True)):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum()))
            start = np.cumsum(count) - count
            total = np.concatenate([[0], np.cumsum(side.size[flat])])
            agree = total[start + count] - total[start] == lengths
            if agree.all() and side.joined(flat) == b"".join(raw):
                pass
            else:
                for i, word in enumerate(raw):
                    agree[i] = agree[i] and side.joined(flat[start[i] : start[i] + count[i]]) == word
            same &= agree
            self.start[k] = np.concatenate([self.start[k], start + len(self.flat[k])])
            self.count[k] = np.concatenate([self.count[k], count])
            wide = np.result_type(self.flat[k], np.min_scalar_type(int(flat.max(initial=0))), np.uint16)
            self.flat[k] = np.concatenate([self.flat[k].astype(wide, copy=False), flat.astype(wide)])
        self.same = np.concatenate([self.same, same])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of each text; None if it has no tokens."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
            release()
        numbers, new = [], []
        for text in texts:
            if not text:
                numbers.append(None)
                continue
            words = _SEGMENT.findall(" " + text) if self.cuts else [" " + text, ""]
            own = np.empty(len(words) - 1, np.int64)  # the last match is empty
            for i, word in enumerate(words[:-1]):
                n = self.number.get(word)
                if n is None:
                    n = self.number[word] = len(self.number)
                    new.append(word)
                own[i] = n
            numbers.append(own)
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        out = []
        for text, own in zip(texts, numbers, strict=True):
            if own is None:
                out.append(None)
                continue
            ids = tuple(spread(self.flat[k], self.start[k][own], self.count[k][own]) for k in (0, 1))
            if not self.same[own].all():  # parts that differ could still join to the text
                whole = (" " + text).encode()
                ids = ids if all(s.joined(x) == whole for s, x in zip(self.sides, ids, strict=True)) else None
            out.append(ids if ids and len(ids[0]) and len(ids[1]) else None)
        return out


_EVENTS = "key long, rid long, id {kind}, side tinyint, base long, bytes long, width tinyint, ids binary"


def events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of token ends of documents (``id``, ``text``): side 0 is A, 1 is B, -1 says that there are no tokens.

    ``base`` is the offset of a chunk in its text, ``bytes`` the text's length. ``key``
    deals documents; rows of one key are told apart by ``rid``.
    """
    kind = docs.schema["id"].dataType.simpleString()
    cache = ("align", a_path, b_path)
    names = ["key", "rid", "id", "side", "base", "bytes", "width", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache(cache, lambda: Encoder(a_path, b_path))
        for part in (b for batches_ in runs_by_chars(batches) for b in batches_):
            encoded = model.encode(part.column(1).to_pylist())
            at, rows = [], []
            for i, ids in enumerate(encoded):
                if ids is None:
                    at.append(i)
                    rows.append((-1, 0, 0, 2, b""))
                    continue
                for k, own in enumerate(ids):
                    ends = np.cumsum(model.sides[k].size[own])
                    cuts = np.searchsorted(ends, np.arange(CHUNK_BYTES, ends[-1], CHUNK_BYTES), "right")
                    cuts = np.unique(np.concatenate([[0], cuts, [len(own)]]))
                    for i0, i1 in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        at.append(i)
                        rows.append((k, int(ends[i0 - 1]) if i0 else 0, int(ends[-1]), own.itemsize, own[i0:i1].tobytes()))
            index = pa.array(at, pa.int64())
            side, base, size, width, data = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [part.column(2).take(index), part.column(3).take(index), part.column(0).take(index), pa.array(side, pa.int8()), pa.array(base, pa.int64()), pa.array(size, pa.int64()), pa.array(width, pa.int8()), pa.array(data, pa.binary())],
                names,
            )

    own = docs.select("id", "text", F.xxhash64("id", "text").alias("key"), F.monotonically_increasing_id().alias("rid"))
    return own.mapInArrow(run, _EVENTS.format(kind=kind))


class Machine:
    """Sweeps ends in order; positions go on from document to document, so one run of numbers holds many."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        self.sizes = sizes
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.origin = self.total = 0
        #: Documents in order: (id, rid, first position, last position); the first may be half done.
        self.docs: list[tuple] = []
        self.open: dict | None = None
        labels = [str(i).encode() + b"," for i in range(max(map(len, sizes)))]
        self.label_size = np.fromiter(map(len, labels), np.int64, len(labels))
        self.label_start = np.cumsum(self.label_size) - self.label_size
        self.label_flat = np.frombuffer(b"".join(labels), np.uint8)

    def add(self, rows: list[tuple]) -> Iterator[tuple]:
        """Takes rows (``rid``, ``id``, ``side``, ``base``, ``bytes``, ``ids``) in order; yields finished documents."""
        more: list[list[np.ndarray]] = [[], []]
        starts: list[list[int]] = [[], []]
        none = []
        for rid, doc, side, base, size, ids in rows:
            if side < 0:
                none.append((doc, rid, 0, 0, 0, 0, "", b"", b""))
                continue
            if not self.docs or self.docs[-1][1] != rid:
                self.docs.append((doc, rid, self.total, self.total + size))
                self.origin, self.total = self.total, self.total + size
            more[side].append(ids)
            starts[side].append(self.origin + base)
        yield from none
        for k in (0, 1):
            if more[k]:
                counts = np.fromiter(map(len, more[k]), np.int64, len(more[k]))
                flat = np.concatenate(more[k]).astype(np.int64)
                run = np.cumsum(self.sizes[k][flat])
                first = np.concatenate([[0], run[np.cumsum(counts)[:-1] - 1]])
                ends = run + np.repeat(np.array(starts[k]) - first, counts)
                self.ids[k] = np.concatenate([self.ids[k], flat])
                self.ends[k] = np.concatenate([self.ends[k], ends])
        if len(self.ends[0]) and len(self.ends[1]):
            yield from self._sweep()

    def _sweep(self) -> Iterator[tuple]:
        common = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        if not len(common):
            return
        ids, group, n = [], [], len(common)
        for k in (0, 1):
            stop = int(np.searchsorted(self.ends[k], common[-1], "right"))
            ids.append(self.ids[k][:stop])
            group.append(np.searchsorted(common, self.ends[k][:stop]))
            self.ids[k], self.ends[k] = self.ids[k][stop:], self.ends[k][stop:]
        na, nb = (np.bincount(g, minlength=n) for g in group)
        # The text a1,a2|b1;...: tokens by group, A before B, then the last mark of each run is set.
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        both = np.concatenate(ids)[order]
        stops = np.cumsum(self.label_size[both])
        text = spread(self.label_flat, self.label_start[both], self.label_size[both])
        of_group = np.cumsum(na + nb)
        text[stops[of_group - nb - 1] - 1] = ord("|")
        text[stops[of_group - 1] - 1] = ord(";")
        text_stop = stops[of_group - 1]
        # Links: every A token with every B token of its group.
        width = nb[group[0]]
        a = np.repeat(ids[0], width)
        b_first = np.cumsum(nb) - nb
        pairs = a << 32 | spread(ids[1], b_first[group[0]], width)
        link_stop = np.cumsum(na * nb)
        a_stop, b_stop = np.cumsum(na), np.cumsum(nb)
        low = 0
        while self.docs and self.docs[0][2] < common[-1]:
            doc, rid, _, last = self.docs[0]
            high = int(np.searchsorted(common, last, "right"))
            now = self.open or {"a": 0, "b": 0, "groups": 0, "links": 0, "sha": hashlib.sha256(), "pairs": [], "times": []}
            if high > low:
                at = lambda sums: int(sums[high - 1] - (sums[low - 1] if low else 0))  # noqa: B023, E731
                now["a"] += at(a_stop)
                now["b"] += at(b_stop)
                now["links"] += at(link_stop)
                t0, t1 = int(text_stop[low - 1]) if low else 0, int(text_stop[high - 1])
                if now["groups"]:
                    now["sha"].update(b";")
                now["groups"] += high - low
                now["sha"].update(text[t0 : t1 - 1].tobytes())
                own, times = np.unique(pairs[int(link_stop[low - 1]) if low else 0 : int(link_stop[high - 1])], return_counts=True)
                if now["pairs"]:
                    own, back = np.unique(np.concatenate([now["pairs"][0], own]), return_inverse=True)
                    times = np.bincount(back, np.concatenate([now["times"][0], times])).astype(np.int64)
                now["pairs"], now["times"] = [own], [times]
                low = high
            if common[low - 1] < last if low else True:
                self.open = now
                return
            self.open = None
            self.docs.pop(0)
            own, times = now["pairs"][0], now["times"][0]
            yield doc, rid, now["a"], now["b"], now["groups"], now["links"], now["sha"].hexdigest(), own.astype("<i8").tobytes(), times.astype("<u4").tobytes()


def sweep(dealt: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents with their groups and links from events dealt by document and sorted by offset.

    ``pairs`` holds the distinct linked pairs, A's id in the upper 32 bits, 8 bytes each;
    ``times`` how often each is linked, 4 bytes each.
    """
    kind = dealt.schema["id"].dataType.simpleString()
    cache = ("align", a_path, b_path)
    names = ["id", "rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    columns = f"id {kind}, rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache(cache, lambda: Encoder(a_path, b_path))
        machine = Machine((model.sides[0].size, model.sides[1].size))
        kinds = None

        def out(rows):
            done = list(machine.add(rows))
            arrays = list(zip(*done, strict=True)) if done else [()] * len(names)
            types = [kinds, *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types, strict=True)], names)

        rows, tokens = [], 0
        for batch in batches:
            kinds = batch.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(row[6], f"<u{row[5]}") if row[2] >= 0 else None
                rows.append((row[0], row[1], row[2], row[3], row[4], ids))
                tokens += 0 if ids is None else len(ids)
                if tokens >= SWEEP_TOKENS:
                    yield out(rows)
                    rows, tokens = [], 0
        if rows:
            yield out(rows)

    return dealt.select("rid", "id", "side", "base", "bytes", "width", "ids").mapInArrow(run, columns)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``top`` (no pair of its A id counts more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("pair-counts", dict)
        pairs, counts, held = [], [], 0

        def out():
            own, back = np.unique(np.concatenate(pairs), return_inverse=True)
            return own, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            own = np.frombuffer(b"".join(x or b"" for x in batch.column(0).to_pylist()), "<i8")
            if not len(own):
                continue
            own, n = np.unique(own, return_counts=True)
            pairs.append(own)
            counts.append(n.astype(np.int64))
            held += len(own)
            if held > COUNT_PAIRS:
                own, n = out()
                pairs, counts, held = [own], [n], len(own)
                if held > COUNT_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["pair", "n"])
                    pairs, counts, held = [], [], 0
        if pairs:
            own, n = out()
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["pair", "n"])

    counted = staged(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    a_id = F.shiftright("pair", 32).alias("a")
    # A row an id of A's vocabulary, which bounds it.
    most = counted.groupBy(a_id).agg(F.max("n").alias("most"))
    return staged(counted.select("*", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top")), "align-tops")


def _sent(counts: DataFrame, limit: int) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The commonest pairs, ``limit`` at most, sorted, and the count from which on they are there."""
    by_n = counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().orderBy(F.desc("n")).collect()  # 10,000 rows at most
    total, least = 0, 1 << 62
    for n, many in by_n:
        if total + many > limit:
            break
        total, least = total + many, n
    rows = counts.filter(F.col("n") >= least).toArrow()
    pair = rows.column("pair").to_numpy()
    order = np.argsort(pair)
    return least, (pair[order], rows.column("n").to_numpy()[order], rows.column("top").to_numpy()[order])


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, send_pairs: int | None = None
) -> DataFrame:
    """One row a document: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    import public_tokenizers

    spark = docs.sparkSession
    ship_code(spark)
    a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
    b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = events(own, a_path, b_path).repartition("key").sortWithinPartitions("key", "rid", "base", "side")
    aligned = staged(sweep(dealt, a_path, b_path), "aligned")
    counts = pair_counts(aligned)
    least, table = _sent(counts, SEND_PAIRS if send_pairs is None else send_pairs)
    table = spark.sparkContext.broadcast(table)
    cache = unique_key("pair-table")

    def look(batch: pa.RecordBatch, place: int):
        """The batch's pairs, times, documents, and where each pair is in the table (-1: not there)."""
        pair, _, _ = worker_cache(cache, lambda: table.value)
        sizes = np.array([len(x or b"") // 8 for x in batch.column(place).to_pylist()], np.int64)
        pairs = np.frombuffer(b"".join(x or b"" for x in batch.column(place).to_pylist()), "<i8")
        times = np.frombuffer(b"".join(x or b"" for x in batch.column(place + 1).to_pylist()), "<u4").astype(np.int64)
        own, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(pair, own)
        at[at == len(pair)] = 0
        at = np.where(pair[at] == own, at, -1) if len(pair) else np.full(len(own), -1)
        return pairs, times, np.repeat(np.arange(len(sizes)), sizes), at[back]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, times, doc, at = look(batch, 7)
            _, n, top = worker_cache(cache, lambda: table.value)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if len(n):
                known = at >= 0
                np.add.at(best, doc[known], times[known] * top[at[known]])
                np.add.at(total, doc[known], times[known] * n[at[known]])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(best), pa.array(total)], [*batch.schema.names[:7], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, doc, at = look(batch, 1)
            left = at < 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[left])), pa.array(pairs[left]), pa.array(times[left])], ["rid", "pair", "times"])

    kind = aligned.schema["id"].dataType.simpleString()
    out = aligned.mapInArrow(told, f"id {kind}, rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rest = counts.filter(F.col("n") < least)
    if not rest.isEmpty():
        few = aligned.select("rid", "pairs", "times").mapInArrow(others, "rid long, pair long, times long").join(rest, "pair")
        few = few.groupBy("rid").agg(F.sum(F.col("times") * F.col("top").cast("long")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
        zero = F.lit(0).cast("long")
        out = out.join(few, "rid", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", zero)).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", zero))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
