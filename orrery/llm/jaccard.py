"""N-gram Jaccard join of documents by chosen paths.

Documents are sets of shingles of five words (lower-case runs of ASCII letters,
digits and non-ASCII characters; a shorter document is one shingle of all its
words). Documents of equal words are one *text* and are joined once.

Each text has a sketch of ``SKETCH`` tokens, its least shingles under as many hash
functions. The join splits recursively: a node holds the texts that share its path;
the node's path chooses ``BRANCHES`` of the sketch's places, and a text goes on to
the children named by its tokens there. So two texts of similarity s meet in a
child for each chosen token that they share. A node of at most ``BUCKET`` texts is
compared by brute force; a larger one has a representative first: texts whose sketch
agrees with its in ``REP_AGREEMENT`` are candidates with it, and near copies of it
(``SETTLED``) are done, for a text that would be a candidate with such a copy differs from the
representative in no more places than the two differences together, so it has become a candidate too: nothing
is lost by it. The others
are split again, up to ``DEPTH`` times, and
what is then still together is taken as one group of candidates. So a large group of
near copies is settled at its first node. Of a pair at the
threshold a run finds a share of at least the recursion's fixed point whatever the
depth; ``runs_for`` gives the runs that reach the target recall.

Candidates are verified exactly: the texts of a connected group of candidates are
compared with one another over their whole shingle sets, in blocks of about ``BLOCK``
texts a side (fewer, if they are long), so also a pair that no run brought together counts. A block emits
the number of links of each text and links enough to connect what is connected;
the links of a large group are never listed.

Defined results: null and empty texts have no shingle and are linked to nothing;
documents with a null id get a null class and no links; a repeated id counts as
the documents that its rows are; an empty table gives an empty table; columns beyond
the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fnv_mix, ship_code, slices_by_chars, staged, worker_cache
from orrery.llm.graph import components, small, spread_join

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Tokens of a sketch; places that a node chooses; texts that are compared by brute force.
SKETCH, BRANCHES, BUCKET, DEPTH = 64, 2, 24, 5
#: Sketches that agree in less than this share are not candidates: 6 standard deviations below the threshold, so
#: no run loses a pair by it though all runs share the sketch.
LEAST_AGREEMENT = 0.5
#: Of sketches of a large node: the share in which a copy agrees with the representative that goes no further, and the one in
#: which a text is a candidate with it. Places in which sketches differ add up at most, so a text that agrees with such a copy
#: in ``LEAST_AGREEMENT`` always reaches the second share.
SETTLED = 0.625
REP_AGREEMENT = SETTLED + LEAST_AGREEMENT - 1
#: Texts and words of a block of the exact comparison, about and at most.
BLOCK, BLOCK_WORDS = 512, 1_000_000
#: Characters of text whose words are hashed at once.
SLICE_CHARS = 1_000_000
#: Texts that at least one in so many documents copies are hot.
HOT = 1_000
#: Ids that a task gets whole, at most.
SEND_IDS = 2_000_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_MULTIPLIERS = fnv_mix(np.arange(SKETCH, dtype=np.uint64), 77) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    """Runs after which a pair of the given similarity is found with the given probability."""
    found = 1.0
    for _ in range(depth):
        found = 1 - (1 - similarity * found) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts, end to end, and each text's number of words."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
    word = _WORD_BYTE[data]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, at = np.flatnonzero(edge == 1), np.flatnonzero(word)
    sizes = np.flatnonzero(np.append(edge, -1 if len(word) and word[-1] else 0) == -1) - starts
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(sizes) - sizes
    powers = np.ones(int(sizes.max()), np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.multiply.accumulate(np.full(len(powers) - 1, _BASE, np.uint64))
        value = (data[at].astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(at)) - np.repeat(first, sizes)]
        hashes = fnv_mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 5)
    ends = np.cumsum([len(r) + 1 for r in raw])
    words = np.searchsorted(starts, ends)
    return hashes, np.diff(words, prepend=0)


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingles of one text, sorted, from its words' hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, size, np.uint64)
        for i in range(size):
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + words[i : i + n]
            mixed ^= mixed >> np.uint64(29)
    return np.unique(fnv_mix(mixed, 11))


def sketch(own: np.ndarray) -> np.ndarray:
    """The least hash of the shingles under each hash function."""
    with np.errstate(over="ignore"):
        least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(own), 2048):
            np.minimum(least, (_MULTIPLIERS[:, None] * own[None, i : i + 2048]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def text_key(words: np.ndarray) -> bytes:
    """128 bits that stand for a text's sequence of words."""
    import xxhash

    return xxhash.xxh3_128_digest(words.tobytes())


def _texts(docs: DataFrame) -> DataFrame:
    """(``id``, ``key``, ``sketch``, ``n_words``) of documents (``id``, ``text``); no words: null."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("sketches", dict)  # what an earlier stage kept goes
        for batch in batches:
            for start, stop in slices_by_chars(batch.column(1), SLICE_CHARS):
                part = batch.slice(start, stop - start)
                hashes, counts = word_hashes(part.column(1).to_pylist())
                keys, sketches, at = [], [], 0
                for n in counts.tolist():
                    own, at = hashes[at : at + n], at + n
                    keys.append(text_key(own) if n else None)
                    sketches.append(sketch(shingles(own)).tobytes() if n else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(counts)], ["id", "key", "sketch", "n_words"])

    return docs.mapInArrow(run, f"id {kind}, key binary, sketch binary, n_words long")


def _children(nodes: DataFrame) -> DataFrame:
    """The nodes that texts (``node``, ``key``, ``sketch``) go on to: (``node``, ``key``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(SKETCH, dtype=np.uint64)
        for batch in batches:
            node = batch.column(0).to_numpy().astype(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SKETCH)
            paths, back = np.unique(node, return_inverse=True)
            chosen = np.empty((len(paths), BRANCHES), np.int64)
            for i in range(0, len(paths), 4096):
                order = fnv_mix(fnv_mix(paths[i : i + 4096, None], 3) + places[None, :], 4)
                chosen[i : i + 4096] = np.argpartition(order, BRANCHES - 1, axis=1)[:, :BRANCHES]
            for b in range(BRANCHES):
                place = chosen[back, b]
                with np.errstate(over="ignore"):
                    token = tokens[np.arange(len(node)), place].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(40))
                    child = fnv_mix(fnv_mix(node, 6) ^ fnv_mix(token, 7), 8)
                yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), batch.column(1)], ["node", "key"])

    return nodes.select("node", "key", "sketch").mapInArrow(run, "node long, key binary")


def _bucket_links(members: DataFrame, rows: int) -> DataFrame:
    """Pairs (``a``, ``b``) of small nodes, of about ``rows`` members, whose sketches agree enough."""
    dealt = small(members.select("node", "key", "sketch").repartition("node"), rows).sortWithinPartitions("node", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_node, left_key, left_sketch = np.empty(0, np.int64), [], np.empty((0, SKETCH), np.uint32)
        for batch in batches:
            node = np.concatenate([left_node, batch.column(0).to_numpy()])
            key = left_key + batch.column(1).to_pylist()
            tokens = np.concatenate([left_sketch, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SKETCH)])
            old = len(left_key)
            a, b = [], []
            for step in range(1, len(node)):
                i = np.flatnonzero(node[:-step] == node[step:])
                if not len(i):
                    break
                i = i[i + step >= old]  # the others were compared before
                for j in range(0, len(i), 20_000):
                    k = i[j : j + 20_000]
                    near = k[(tokens[k] == tokens[k + step]).mean(1) >= LEAST_AGREEMENT]
                    a += [key[x] for x in near.tolist()]
                    b += [key[x + step] for x in near.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            # The last node may go on; a node has at most BUCKET texts.
            open_from = int(np.searchsorted(node, node[-1])) if len(node) else 0
            left_node, left_key, left_sketch = node[open_from:], key[open_from:], tokens[open_from:]

    return dealt.mapInArrow(run, "a binary, b binary")


def _settled(nodes: DataFrame) -> DataFrame:
    """The agreement of texts' sketches (``sketch``) with their node's representative (``rep_sketch``): adds ``agreement``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SKETCH) for i in (2, 4)]
            share = (both[0] == both[1]).mean(1) if len(both[0]) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(share)], ["node", "key", "sketch", "rep", "agreement"])

    return nodes.select("node", "key", "sketch", "rep", "rep_sketch").mapInArrow(run, "node long, key binary, sketch binary, rep binary, agreement double")


def candidates(texts: DataFrame, recall: float = RECALL, similarity: float = SIMILARITY) -> DataFrame:
    """Links (``a``, ``b``) that connect the candidate groups of ``texts`` (``key``, ``sketch``)."""
    n_runs = runs_for(recall, similarity)
    rows = texts.count() * n_runs * BRANCHES  # each text goes on to as many children
    runs = F.sequence(F.lit(1), F.lit(n_runs))
    nodes = texts.withColumn("node", F.explode(F.transform(runs, lambda i: F.xxhash64(F.lit("run"), i))))
    links, live = [], texts
    for depth in range(1, DEPTH + 1):
        nodes = staged(_children(nodes), f"nodes{depth}")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        met = staged(small(nodes.join(sizes, "node"), rows), f"met{depth}")
        # Only texts that met another one at this depth can go on; sketches of the others aren't dealt again.
        live = staged(small(live.join(met.select("key").distinct(), "key", "left_semi"), rows), f"live{depth}")
        few = met.filter(F.col("n") <= BUCKET).join(live, "key")
        links.append(staged(small(_bucket_links(few, rows).distinct(), rows), f"links{depth}"))
        large = met.filter(F.col("n") > BUCKET)
        many = large.count()
        if not many:
            break
        # One representative a large node; there are fewer than texts by BUCKET.
        least = large.groupBy("node").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
        reps = staged(small(least.join(live.select(F.col("key").alias("rep"), F.col("sketch").alias("rep_sketch")), "rep"), rows), f"reps{depth}")
        own = staged(small(large.select("node", "key").join(live, "key"), rows), f"large{depth}")
        told = staged(_settled(spread_join(own, reps, "node", "n", many=many)), f"settled{depth}")
        links.append(told.filter((F.col("agreement") >= REP_AGREEMENT) & (F.col("key") != F.col("rep"))).select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct())
        nodes = told.filter(F.col("agreement") < SETTLED).select("node", "key", "sketch")
        rows = nodes.count() * BRANCHES
        if not rows:
            break
    else:
        # What is together after the last depth is one group by its representative, near or not.
        links.append(told.filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct())
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _compare(keys: list[bytes], copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float):
    """Links within one block pair: each text's links, the documents behind them, and connecting links.

    Texts of the same side are compared only if there is one side.
    """
    n = len(keys)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    token, column, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    # Of two sides only what lies across is multiplied: the texts are put in the order of their sides.
    order = np.argsort(side, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    cut = int((~side).sum())
    rows, columns = (slice(0, cut), slice(cut, n)) if 0 < cut < n else (slice(0, n), slice(0, n))
    both = np.zeros((rows.stop - rows.start, columns.stop - columns.start), np.float32)
    by = np.argsort(column, kind="stable")
    column, owner = column[by], place[owner[by]]
    width = max(1, min(8192, 24_000_000 // max(1, n)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        both += part[rows] @ part[columns].T
    whole = sizes[order[rows]][:, None] + sizes[order[columns]][None, :] - both
    near = both >= similarity * whole - 1e-6
    link = np.zeros((n, n), bool)
    link[np.ix_(order[rows], order[columns])] = near
    link[np.ix_(order[columns], order[rows])] = near.T
    np.fill_diagonal(link, False)
    links, behind = link.sum(1), link.astype(np.int64) @ copies
    # Connecting links by spreading from each text not reached yet.
    reached, joins = np.zeros(n, bool), []
    for start in range(n):
        if reached[start] or not links[start]:
            continue
        front = np.array([start])
        reached[start] = True
        while len(front):
            hit = link[front] & ~reached[None, :]
            new = np.flatnonzero(hit.any(0))
            joins += [(int(front[hit[:, x].argmax()]), int(x)) for x in new]
            reached[new] = True
            front = new
    return links, behind, joins


def _verified(members: DataFrame, similarity: float) -> DataFrame:
    """Block results of ``members`` (``gid``, ``side``, ``key``, ``copies``, ``text``) dealt and sorted by ``gid``.

    Rows (``key``, ``links``, ``behind``, ``other``): a text's links in the block, or
    with ``other`` a connecting link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        now = None

        def finish(group):
            seen: dict[bytes, tuple] = {}
            for row in group:
                seen.setdefault(row[0], row)
            rows = list(seen.values())
            if len(rows) < 2:
                return None
            keys = [r[0] for r in rows]
            links, behind, joins = _compare(keys, np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[3] for r in rows]) > 0, similarity)
            hit = np.flatnonzero(links).tolist()
            out = [[keys[i] for i in hit] + [keys[i] for i, _ in joins], [int(links[i]) for i in hit] + [0] * len(joins), [int(behind[i]) for i in hit] + [0] * len(joins), [None] * len(hit) + [keys[j] for _, j in joins]]
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["key", "links", "behind", "other"])

        for batch in batches:
            for gid, key, copies, own, side in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if gid != now:
                    if group and (done := finish(group)) is not None:
                        yield done
                    group, now = [], gid
                group.append((key, copies, own, side))
        if group and (done := finish(group)) is not None:
            yield done

    return members.select("gid", "key", "copies", "own", "side").mapInArrow(run, "key binary, links long, behind long, other binary")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(``key``, ``own``): the shingles of documents (``key``, ``text``) whose words have that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices_by_chars(batch.column(1), SLICE_CHARS):
                part = batch.slice(start, stop - start)
                hashes, counts = word_hashes(part.column(1).to_pylist())
                keys, sets, at = [], [], 0
                for key, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own, at = hashes[at : at + n], at + n
                    if n and text_key(own) == key:
                        keys.append(key)
                        sets.append(shingles(own).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "own"])

    return docs.select("key", "text").mapInArrow(run, "key binary, own binary")


def _classed(named: DataFrame, similarity: float, recall: float) -> DataFrame:
    """A row for each document of ``named`` (``id``, ``text``): ``id``, ``key``, ``class_id``, ``class_key``, ``copies``, ``text_links``, ``behind``.

    Documents of a class share ``class_key``, the key of its first text; without
    words it is null.
    """
    slim = staged(_texts(named), "texts")
    many = slim.count()
    texts = slim.filter("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"), F.max("n_words").alias("n_words"))
    texts = staged(small(texts, many), "distinct-texts")
    groups = components(candidates(texts.select("key", "sketch"), recall, similarity))
    groups = staged(small(groups.join(texts.select(F.col("key").alias("node"), "first_id", "copies", "n_words"), "node"), many), "groups")
    sizes = staged(small(groups.groupBy("root").agg(F.count("*").alias("size"), F.sum("n_words").alias("all_words")), many), "sizes")

    wanted = groups.select(F.col("first_id").alias("id"), F.col("node").alias("key"))
    if wanted.count() <= SEND_IDS:
        wanted = F.broadcast(wanted)
    # Only first documents are read, and of a repeated id the row whose words have the key; equal rows once.
    sets = _shingle_sets(named.join(wanted, "id"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("all_words") / BLOCK_WORDS)).cast("long")
    placed = spread_join(groups, sizes, "root", "size").select(F.col("node").alias("key"), "root", "copies", blocks.alias("nb"))
    placed = placed.withColumn("b", F.pmod(F.xxhash64("key", F.lit(1)), F.col("nb"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    placed = placed.select("key", "copies", F.xxhash64("root", F.least("b", "o"), F.greatest("b", "o")).alias("gid"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    members = placed.join(sets, "key").repartition("gid").sortWithinPartitions("gid", "key")
    found = staged(_verified(members, similarity), "verified")

    per_text = found.filter("other is null").groupBy("key").agg(F.sum("links").alias("text_links"), F.sum("behind").alias("behind"))
    linked = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    linked = linked.withColumnRenamed("node", "key").join(texts.select("key", "first_id"), "key")
    first = F.min(F.struct("first_id", "key"))
    linked = staged(small(linked, many), "linked")
    firsts = staged(small(linked.groupBy("root").agg(first.alias("class"), F.count("*").alias("n")), many), "class-firsts")
    classes = spread_join(linked, firsts, "root", "n").select("key", "class")
    zero = F.lit(0).cast("long")
    texts = texts.join(per_text, "key", "left").join(classes, "key", "left").select(
        "key",
        F.coalesce("class.first_id", "first_id").alias("class_id"),
        F.coalesce("class.key", "key").alias("class_key"),
        "copies",
        F.coalesce("text_links", zero).alias("text_links"),
        F.coalesce("behind", zero).alias("behind"),
    )
    return spread_join(slim.select("id", "key"), staged(small(texts, many), "classes"), "key", "copies", "left", HOT, many)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row a document: ``id_col``, ``class_id``, ``n_copies``, ``n_text_links``, ``n_links``.

    ``class_id`` is the least id of the documents connected by links (its own, if
    none); ``n_copies`` counts the other documents of equal words, ``n_text_links``
    the different texts linked to, ``n_links`` all other documents linked to.
    """
    if not 0 < similarity <= 1 or not 0 < recall < 1:
        raise ValueError("similarity must lie in (0, 1], recall in (0, 1)")
    ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    zero = F.lit(0).cast("long")
    rows = _classed(source.filter("id is not null"), similarity, recall).select(
        F.col("id").alias(id_col),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("copies") - 1, zero).alias("n_copies"),
        F.coalesce("text_links", zero).alias("n_text_links"),
        F.coalesce(F.col("behind") + F.col("copies") - 1, zero).alias("n_links"),
    )
    kind = source.schema["id"].dataType
    unnamed = source.filter("id is null").select(F.col("id").alias(id_col), F.lit(None).cast(kind).alias("class_id"), zero.alias("n_copies"), zero.alias("n_text_links"), zero.alias("n_links"))
    return rows.union(unnamed)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents of ``docs`` but one of each class: the one with the least id.

    Documents with a null id and those without words stay. Rows that share an id are
    documents of their own: each is judged by its text, and of rows with the same id
    and words one stays (the least by its columns' hash).
    """
    ship_code(docs.sparkSession)
    pair = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _classed(pair.filter("id is not null"), similarity, recall)
    rows = staged(rows.filter("key is null or (id = class_id and key = class_key)").select("id", "key"), "kept")
    ids = rows.groupBy("id").agg(F.lit(True).alias("kept"))
    # Where an id is repeated, in what stays or in what goes, the words decide.
    repeated = staged(docs.select(F.col(id_col).alias("id")).filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    sent = lambda few: F.broadcast(few) if few.count() <= SEND_IDS else few
    single = docs.join(sent(ids.join(repeated, "id", "left_anti").select(F.col("id").alias("kept_id"))), F.col(id_col) == F.col("kept_id"), "left_semi")
    out = single.union(docs.filter(F.col(id_col).isNull()))
    if repeated.isEmpty():
        return out
    mark = F.xxhash64(*[F.col(c) for c in docs.columns if "map<" not in dict(docs.dtypes)[c]])
    several = docs.join(sent(repeated.select(F.col("id").alias("many_id"))), F.col(id_col) == F.col("many_id"), "left_semi")
    several = several.select(F.struct(mark.alias("mark"), F.struct(*docs.columns).alias("row")).alias("doc"))
    keyed = _keys(several, id_col, text_col)
    same = (F.col("id") == F.col("kept_id")) & F.col("key").eqNullSafe(F.col("kept_key"))
    keyed = keyed.join(rows.select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key")).distinct(), same, "left_semi")
    words = keyed.filter("key is not null").groupBy("id", "key").agg(F.min_by("doc", "doc.mark").alias("doc")).select("doc")
    return out.union(words.union(keyed.filter("key is null").select("doc")).select("doc.row.*"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` and ``doc`` of documents in the struct ``doc.row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices_by_chars(batch.column(1), SLICE_CHARS):
                part = batch.slice(start, stop - start)
                hashes, counts = word_hashes(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                keys = [text_key(hashes[e - n : e]) if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), part.column(2)], ["id", "key", "doc"])

    own = docs.select(F.col(f"doc.row.{id_col}").alias("id"), F.col(f"doc.row.{text_col}").cast("string").alias("text"), "doc")
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"id {kinds['id']}, key binary, doc {kinds['doc']}")
