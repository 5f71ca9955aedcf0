"""Byte-level BPE encoding and decoding by merge replay.

The distinct pre-tokens of a run of texts are laid end to end as one byte
sequence. An inverted index maps every mergeable rank to the positions of its
left symbols; the ranks are then replayed in order and a merge updates only the
two neighbours it touches. The index is built per task over the words that the
worker has not met before, so nothing is shuffled and no text meets another
task; a bounded cache keeps the words already replayed.

Defined results: a null text counts as empty; an empty text has no ids; a null
document id stays null; repeated rows give repeated results; an empty table
gives an empty table; columns other than the two named are not carried.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import release, ship_code, slices_by_bytes, slices_by_chars, worker_cache

#: Characters of text whose words are replayed together.
SLICE_CHARS = 3_000_000
#: Bytes of ids that are decoded together; the tokens of a vocabulary are some four bytes, so the same as SLICE_CHARS.
DECODE_BYTES = 12_000_000
#: Words that a worker keeps before it starts a new cache.
CACHE_WORDS = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file; the vocabulary is fixed, so this is bounded."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


#: The pattern of the public vocabulary, and what it becomes over the characters
#: of ``PLAIN``, where the standard library's faster matcher gives the same words.
PUBLIC_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
SPACES = "\t\n\r \xa0"
PLAIN = "\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f"
PLAIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


class MergeReplay:
    """Replays the merges of one vocabulary over many words at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(PLAIN_PATTERN) if pattern == PUBLIC_PATTERN else None
        self.not_plain = re.compile(f"[^{PLAIN}]")
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Any split of a token into two tokens may be merged into it.
        keys, made, careful = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(rank)
                    careful.update(x for x in (left, right) if x > rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        #: Ranks whose merge can make a pair of a lower rank; these go one to a word at a time.
        self.careful = careful
        size = max(self.vocabulary) + 1
        tokens = [self.vocabulary.get(i, b"") for i in range(size)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.fromiter(map(len, tokens), np.int64, size)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.forget()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], np.int32(-1))

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words merged together in rank order: the ids, end to end, and each word's number of ids."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.base[np.frombuffer(b"".join(words), np.uint8)]
        n, stops = len(symbol), np.cumsum(sizes)
        # 32 bits a position: a call has the new words of one run, or of one text, whose bytes Arrow counts in 32 bits too.
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[stops - 1] = -1
        before[stops - sizes] = -1
        alive = np.ones(n, bool)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank_at = np.full(n, -1, np.int32)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        rank_at[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters positions under their pairs' ranks."""
            rank = rank_at[at]
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(at)], strict=True):
                r = int(rank[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(queue, r)

        note(inner)
        while queue:
            rank = heapq.heappop(queue)
            parts = index.pop(rank, None)
            if parts is None:
                continue
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            at = np.unique(at)
            gone = after[at]
            if (rank_at[gone] == rank).any():  # such pairs overlap: the left one goes first
                chosen, last = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), gone.tolist(), strict=True)):
                    if p != last:
                        chosen.append(i)
                        last = q
                at = at[chosen]
            if rank in self.careful and len(at) > 1:
                own = word_of[at]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(queue, rank)
                    at = at[first]
            gone = after[at]
            symbol[at] = rank
            rank_at[gone] = -1
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            inside = nxt >= 0
            before[nxt[inside]] = at[inside]
            rank_at[at[~inside]] = -1
            prev = before[at]
            touched = np.concatenate([at[inside], prev[prev >= 0]])
            if len(touched):
                rank_at[touched] = self.pair_ranks(symbol[touched], symbol[after[touched]])
                note(touched)
        counts = np.add.reduceat(alive.astype(np.int64), stops - sizes)
        return symbol[alive].astype(np.uint32), counts

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat = np.empty(0, np.uint32)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def learn(self) -> None:
        """Replays the words that got a number since the last call."""
        words = list(islice(self.number, len(self.start), None))
        if not words:
            return
        raw = list(map(str.encode, words))
        whole = np.fromiter((self.ranks.get(data, -1) for data in raw), np.int64, len(raw))
        hard = np.flatnonzero(whole < 0)
        ids, sizes = self.replay([raw[i] for i in hard.tolist()])
        counts = np.ones(len(words), np.int64)
        counts[hard] = sizes
        flat = np.empty(int(counts.sum()), np.uint32)
        start = np.cumsum(counts) - counts
        flat[start[whole >= 0]] = whole[whole >= 0]
        merged = np.repeat(whole < 0, counts)
        flat[merged] = ids
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat])

    def words(self, text: str) -> list[str]:
        if self.plain is not None and self.not_plain.search(text) is None:
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; of a very long text, a bounded run of words at a time."""
        if not text:
            return np.empty(0, np.int64)
        look = self.number.__getitem__
        if len(text) <= SLICE_CHARS:
            words = self.words(text)
            return np.fromiter(map(look, words), np.int64, len(words))
        return np.fromiter((look(m.group()) for m in self.pattern.finditer(text)), np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
            release()
        numbers = [self.numbers(t) for t in texts]
        self.learn()
        return [spread(self.flat, self.start[n], self.count[n]) for n in numbers]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        return spread(self.token_bytes, self.token_start[ids], self.token_size[ids])


def spread(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], end to end."""
    stops = np.cumsum(count)
    total = int(stops[-1]) if len(stops) else 0
    return flat[np.repeat(start - (stops - count), count) + np.arange(total)]


def binary_array(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow binary column of the arrays' bytes (with 64-bit offsets, then narrowed)."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([p.nbytes for p in parts], out=offsets[1:])
    data = np.concatenate(parts).tobytes() if parts else b""
    wide = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(parts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )
    return wide.cast(pa.binary())


def runs_by_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, up to about ``SLICE_CHARS`` characters; larger ones cut."""
    run, total = [], 0
    for batch in batches:
        for start, stop in slices_by_chars(batch.column(1), SLICE_CHARS):
            part = batch.slice(start, stop - start)
            size = part.column(1).nbytes
            if run and total + size > SLICE_CHARS:
                yield run
                run, total = [], 0
            run.append(part)
            total += size
    if run:
        yield run


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(
    df: DataFrame, id_col: str, text_col: str, ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id_col`` and ``ids``: the ids of the whole text, 4 little-endian bytes each."""
    spark: SparkSession = df.sparkSession
    ship_code(spark)
    path, default_pattern = default_ranks() if ranks_path is None or pattern is None else (ranks_path, pattern)
    path, pattern = ranks_path or path, pattern or default_pattern
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    key = ("bpe", path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache(key, lambda: MergeReplay(ranks.value, pattern))
        for run in runs_by_chars(batches):
            ids = model.encode([t for batch in run for t in batch.column(1).to_pylist()])
            at = 0
            for batch in run:
                yield pa.RecordBatch.from_arrays([batch.column(0), binary_array(ids[at : at + len(batch)])], ["id", "ids"])
                at += len(batch)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary").select(F.col("id").alias(id_col), "ids")


def decode(
    df: DataFrame, id_col: str, ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``id_col`` and ``decoded``: the bytes that the ids stand for (null ids: no bytes)."""
    spark = df.sparkSession
    ship_code(spark)
    path, default_pattern = default_ranks() if ranks_path is None or pattern is None else (ranks_path, pattern)
    path, pattern = ranks_path or path, pattern or default_pattern
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    key = ("bpe", path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_cache(key, lambda: MergeReplay(ranks.value, pattern))
        for batch in batches:
            for start, stop in slices_by_bytes(batch.column(1), DECODE_BYTES):
                part = batch.slice(start, stop - start)
                data = [model.decode(np.frombuffer(ids or b"", "<u4")) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary_array(data)], ["id", "ids", "decoded"])

    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids binary, decoded binary").select(
        F.col("id").alias(id_col), "ids", "decoded"
    )


def digests(df: DataFrame, id_col: str) -> DataFrame:
    """The contract's columns of encoded and decoded documents."""
    return df.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
