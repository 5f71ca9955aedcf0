"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source is cut into blocks of ``block_rows`` rows. Block ``i`` (from 1) of a
source with weight ``w`` is released at slot ``floor((i - 1) / w)`` and due by
slot ``ceil(i / w)``; each slot takes the released block with the earliest
deadline. In every prefix of a phase a source then has less than one block more or
less than its weight asks for, however long the phase is: releases and deadlines
are built from the weight itself, as a fraction of ``PRECISION`` (over a thousand
million slots its rounding adds up to less than a millionth of a block).

A source that has no block left drops out and the weights of the others grow in
proportion; this starts a new phase, scheduled in the same way. So no row is
dropped or repeated, and the result says in which phase a row lies. The phases are
computed from one row per source.

The driver computes the phases alone: per phase its length, and each source's weight
and blocks so far. Slots are planned by tasks, ``CHUNK_SLOTS`` of a phase at a time and none waiting
for another. As each source's share of the first ``t`` slots lies within one block of
``t * w``, what is placed before a chunk is known but for the blocks whose window lies
across its border; of these the ones due first go before it, as far as those released
by then leave room (``_ahead``). Both sides then meet all windows, and a chunk, which is
no shorter than any window, is scheduled by deadlines within itself. Only a phase in which a
source has less than one block in ``MOST_CHUNK_SLOTS`` is planned in turn on the driver, in pieces. Rows meet the slots only through a join,
by broadcast up to ``SEND_BLOCKS`` blocks. Everything that touches rows or slots is a
DataFrame operation.

Blocks need not follow the order of the table: rows are dealt by hash into shards
of a source that fit a task, and a source's blocks are its shards end to end. A
source with a third of all rows is spread over as many shards as it needs.

Defined results: a null source is a source of its own; null ids and texts are rows
like any other; repeated rows each get a place of their own; an empty table gives
an empty table; a source without a target weight, or with a weight of 0, comes after all
others; columns that have the added names (``ADDED``) are left out, all others come back unchanged.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import scratch_path, staged

#: Rows of a block.
BLOCK_ROWS = 16
#: Blocks of a source that one row of the schedule's table holds.
PERIOD = 720
#: Parts of the whole that weights are rounded to: twice ``HALF`` bits, so that products of slots and parts fit longs.
HALF = 25
PRECISION = 1 << 2 * HALF
#: Slots of a phase, at most, for the same reason; more raise an error that asks for larger blocks.
MAX_SLOTS = 1 << 37
#: Slots that are planned together: as many as the longest window, and at least and at most so many. A chunk's work grows
#: with its square, and at most so many times ``PRECISION`` fits a long.
CHUNK_SLOTS, MOST_CHUNK_SLOTS = 128, 4_000
#: Slots that one row of the plan is dealt with, and slots of a task with the shortest chunks, about.
DEALT_SLOTS, TASK_SLOTS = 2_048, 65_536
#: The columns that a schedule adds.
ADDED = ("mix_block", "mix_phase", "mix_slot", "mix_place")
#: Numbers of the phases' table that the driver holds at once, and blocks that are sent to every task, at most.
PIECE_NUMBERS, SEND_BLOCKS = 1_000_000, 4_000_000
#: Sources whose names are sent to every task, at most; more meet the rows in a shuffle.
SEND_SOURCES = 100_000
#: Rows that a shard of a source holds at most, about, and the shards that a small source is cut into.
SHARD_ROWS, SMALL_SHARD_ROWS, SMALL_SHARDS = 20_000, 64, 2_048


@dataclass(frozen=True)
class Phase:
    """``length`` slots from ``first_slot``; of each source (by place in the list of sources) its parts of ``PRECISION`` and its blocks placed before."""

    phase: int
    first_slot: int
    length: int
    sources: list[int]
    parts: list[int]
    done: list[int]


def quantise(weights: list[float], period: int) -> list[int]:
    """Whole blocks a period, at least one each, by largest remainders."""
    total = math.fsum(weights)
    exact = [w / total * period for w in weights]
    counts = [max(1, math.floor(x)) for x in exact]
    over = sum(counts) - period
    if over < 0:
        order = sorted(range(len(weights)), key=lambda s: (counts[s] - exact[s], s))
        for at in range(-over):
            counts[order[at % len(order)]] += 1
    for _ in range(over):  # sources raised to one block take from the largest
        largest = max(range(len(counts)), key=lambda s: (counts[s] - exact[s] if counts[s] > 1 else -1, counts[s]))
        counts[largest] -= 1
    return counts


def _ahead(parts: list[int], border: int) -> list[int]:
    """Each source's blocks within the first ``border`` slots of a phase.

    In order of release, at least the whole part of the blocks' shares must lie
    before the border, so a block is free to take one of the places from the
    share before it on; blocks that are due first choose first.
    """
    whole, rest = zip(*(divmod(border * c, PRECISION) for c in parts), strict=True)
    out, opens, total = list(whole), {}, 0
    across = [s for s in range(len(parts)) if rest[s]]
    for s in sorted(across, key=lambda s: (rest[s] // -parts[s], s)):
        opens[s] = total // PRECISION
        total += rest[s]
    places = list(range(total // PRECISION))
    for s in sorted(across, key=lambda s: (-((rest[s] - PRECISION) // parts[s]), s)):
        at = bisect_left(places, opens[s])
        if at < len(places):
            del places[at]
            out[s] += 1
    return out


def phases(blocks: list[int], weights: list[float]) -> Iterator[Phase]:
    """The phases of sources with so many blocks: each ends with the last block of the source that runs out first."""
    if any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite and not negative")
    done, first, phase = [0] * len(blocks), 0, 0
    left = [s for s, n in enumerate(blocks) if n > 0]
    while left:
        active = [s for s in left if weights[s] > 0]
        parts = quantise([weights[s] for s in active] if active else [1.0] * len(left), PRECISION)
        active = active or left
        ends = [(blocks[s] - done[s]) * PRECISION // c for s, c in zip(active, parts, strict=True)]
        length = min(ends)
        if length >= MAX_SLOTS:
            raise ValueError(f"{length} slots in a phase; make the blocks larger")
        # The source that runs out comes first: its last block is due at once and chooses first.
        order = sorted(range(len(active)), key=lambda i: (ends[i] != length, i))
        active, parts = [active[i] for i in order], [parts[i] for i in order]
        yield Phase(phase, first, length, active, parts, [done[s] for s in active])
        for s, n in zip(active, _ahead(parts, length), strict=True):
            done[s] += n
        left = [s for s in left if done[s] < blocks[s]]
        first, phase = first + length, phase + 1


def flattened(sizes: dict[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights that flatten the sources' sizes: rows to a power."""
    return {s: float(n) ** power for s, n in sizes.items()}


def _inlined(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a table."""
    fields = ",".join(":".join(x.split(" ")) for x in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def chunk_size(phase: Phase) -> int | None:
    """Slots of the phase's chunks: at least as many as any block's window, so that none spans a chunk; None if these are too many."""
    window = max(-(-PRECISION // c) for c in phase.parts)
    if phase.length < 2 * MOST_CHUNK_SLOTS:
        return min(MOST_CHUNK_SLOTS, max(CHUNK_SLOTS, window))
    return max(CHUNK_SLOTS, window) if window <= MOST_CHUNK_SLOTS else None


def in_turn(phase: Phase) -> Iterator[tuple[int, int]]:
    """The source and block of each slot of a phase, one after the other."""
    last = _ahead(phase.parts, phase.length)
    taken = [0] * len(last)
    waiting = [(0, -(-PRECISION // c), s) for s, c in enumerate(phase.parts) if last[s]]  # a source's next block only
    ready: list[tuple[int, int]] = []
    for slot in range(phase.length):
        while waiting and waiting[0][0] <= slot:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        due, s = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        taken[s] += 1
        i, c = taken[s], phase.parts[s]
        if i < last[s]:
            heapq.heappush(waiting, (i * PRECISION // c, -(-(i + 1) * PRECISION // c), s))
        yield phase.sources[s], phase.done[s] + i - 1


def planned(spark: SparkSession, found: Iterator[Phase]) -> DataFrame:
    """(``source``, ``block``, ``slot``, ``phase``) of every block of the phases.

    The driver holds pieces of ``PIECE_NUMBERS`` at most, which go to two tables: phases to
    plan by chunks, and what was planned in turn.
    """
    schemas = {
        "mix-phases": "phase int, first long, length long, size long, sources array<int>, parts array<long>, done array<long>",
        "mix-in-turn": "phase int, first long, sources array<int>, blocks array<long>",
    }
    paths = {name: scratch_path(spark, name) for name in schemas}
    rows: dict[str, list[dict]] = {name: [] for name in schemas}
    held = dict.fromkeys(schemas, 0)

    def put(name: str, row: dict | None = None, numbers: int = 0) -> None:
        if row is not None:
            rows[name].append(row)
            held[name] += numbers
        if row is None or held[name] >= PIECE_NUMBERS:
            _inlined(spark, rows[name], schemas[name]).write.mode("append").parquet(paths[name])
            rows[name].clear()
            held[name] = 0

    work = 0
    for p in found:
        size = chunk_size(p)
        if size is not None:
            work += p.length * size
            put("mix-phases", {"phase": p.phase, "first": p.first_slot, "length": p.length, "size": size, "sources": p.sources, "parts": p.parts, "done": p.done}, 3 * len(p.sources))
            continue
        turns, first = in_turn(p), p.first_slot
        while own := list(islice(turns, DEALT_SLOTS)):
            put("mix-in-turn", {"phase": p.phase, "first": first, "sources": [s for s, _ in own], "blocks": [i for _, i in own]}, 2 * len(own))
            first += len(own)
    for name in schemas:
        put(name)
    phased, turned = (spark.read.schema(schemas[name]).parquet(paths[name]) for name in schemas)
    turned = turned.selectExpr("phase", "first", "posexplode(arrays_zip(sources, blocks)) as (at, b)")
    turned = turned.selectExpr("b.sources as source", "b.blocks as block", "first + at as slot", "phase")
    return _by_chunks(phased, max(1, -(-work // (TASK_SLOTS * CHUNK_SLOTS)))).union(turned)


def _border(slot: str) -> tuple[str, str, str]:
    """SQL of what ``_ahead`` computes for a border ``slot``, in three steps: shares, blocks across it, blocks before it.

    The steps read the columns ``parts``, ``{slot}_shares`` and ``{slot}_across``.
    """
    low = (1 << HALF) - 1
    lower, upper = f"{slot} * (c & {low}L)", f"({slot} * shiftright(c, {HALF}) + shiftright({slot} * (c & {low}L), {HALF}))"
    shares = f"transform(parts, (c, s) -> struct(shiftright({upper}, {HALF}) as whole, shiftleft({upper} & {low}L, {HALF}) + ({lower} & {low}L) as rest, c, s))"
    one = f"{PRECISION}L"
    across = f"""aggregate(
        array_sort(transform(filter({slot}_shares, x -> x.rest > 0), x -> struct(-((x.rest + x.c - 1) div x.c) as age, x.s as s, x.rest as rest, ({one} - x.rest + x.c - 1) div x.c as due))),
        struct(0L as places, 0L as part, cast(array() as array<struct<due: bigint, s: int, opens: bigint>>) as blocks),
        (a, x) -> struct(
            a.places + shiftright(a.part + x.rest, {2 * HALF}) as places, (a.part + x.rest) & ({one} - 1) as part,
            array_append(a.blocks, struct(x.due as due, x.s as s, a.places as opens)) as blocks))"""
    ahead = f"""aggregate(
        array_sort({slot}_across.blocks),
        struct(if({slot}_across.places > 0, sequence(0L, greatest({slot}_across.places - 1, 0L)), cast(array() as array<bigint>)) as places, cast(array() as array<int>) as taken),
        (a, x) -> {_first_free("x.opens", "array_append(a.taken, x.s)", "a.taken")},
        a -> transform({slot}_shares, x -> x.whole + if(array_contains(a.taken, x.s), 1L, 0L)))"""
    return shares, across, ahead


def _first_free(opens: str, taken: str, otherwise: str) -> str:
    """SQL: takes the first free place from ``opens`` on, if there is one."""
    free = f"get(filter(a.places, p -> p >= {opens}), 0)"
    return f"if({free} is null, struct(a.places as places, {otherwise} as taken), struct(array_remove(a.places, {free}) as places, {taken} as taken))"


def _by_chunks(table: DataFrame, tasks: int) -> DataFrame:
    """The blocks of the phases in ``table``, each chunk by itself; the last chunk of a phase is up to twice as long."""
    many = f"greatest(1, {DEALT_SLOTS} div size)"
    dealt = table.withColumn("chunks", F.expr("greatest(1, length div size)"))
    dealt = dealt.withColumn("at", F.expr(f"explode(sequence(0L, (chunks - 1) div {many}))")).repartition(tasks, "phase", "at")
    chunks = dealt.withColumn("k", F.expr(f"explode(sequence(at * {many}, least((at + 1) * {many}, chunks) - 1))"))
    chunks = chunks.withColumn("t0", F.expr("k * size")).withColumn("t1", F.expr("if(k = chunks - 1, length, t0 + size)"))
    for slot in ("t0", "t1"):
        for name, sql in zip(("shares", "across", "before"), _border(slot), strict=True):
            chunks = chunks.withColumn(f"{slot}_{name}", F.expr(sql))
    # Windows relative to the chunk: parts by which a block begins and ends after the shares at its first slot.
    window = lambda i: f"(({i} - x.whole) * {PRECISION}L - x.rest)"
    blocks = f"""array_sort(flatten(transform(t0_shares, x -> if(t1_before[x.s] > t0_before[x.s], transform(
        sequence(t0_before[x.s] + 1, t1_before[x.s]),
        i -> struct(({window("i")} + x.c - 1) div x.c as due, x.s as s, i as i, if(i - 1 <= x.whole, 0L, {window("i - 1")} div x.c) as opens)),
        cast(array() as array<struct<due: bigint, s: int, i: bigint, opens: bigint>>)))))"""
    placed = "array_append(a.taken, struct(x.s as s, x.i as i, get(filter(a.places, p -> p >= x.opens), 0) as place))"
    chunks = chunks.withColumn("blocks", F.expr(blocks)).withColumn("taken", F.expr(f"""aggregate(
        blocks,
        struct(sequence(0L, t1 - t0 - 1) as places, cast(array() as array<struct<s: int, i: bigint, place: bigint>>) as taken),
        (a, x) -> {_first_free("x.opens", placed, "a.taken")}, a -> a.taken)"""))
    whole = F.when(F.size("taken") == F.col("t1") - F.col("t0"), F.col("taken")).otherwise(F.raise_error(F.lit("a block missed its window")))
    return chunks.select("phase", "first", "t0", "sources", "done", F.explode(whole).alias("b")).selectExpr(
        "sources[b.s] as source", "done[b.s] + b.i - 1 as block", "first + t0 + b.place as slot", "phase"
    )


def slot_table(blocks: DataFrame, size: int) -> DataFrame:
    """(``source``, ``chunk``, ``slots``, ``phases``): where ``size`` blocks of a source, from block ``chunk * size``, go."""
    rows = blocks.groupBy("source", F.floor(F.col("block") / size).cast("long").alias("chunk"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("block", "slot", "phase"))).alias("own"))
    return staged(rows.select("source", "chunk", F.col("own.slot").alias("slots"), F.col("own.phase").alias("phases")), "mix-slots")


def schedule(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
) -> DataFrame:
    """The rows of ``docs`` with ``mix_block``, ``mix_phase``, ``mix_slot`` and ``mix_place``.

    ``mix_place`` orders the mix: the slot of the row's block times ``block_rows``,
    plus the row's place in the block. Without ``weights`` they are the square roots
    of the sources' numbers of rows.
    """
    if block_rows < 1 or period < 1:
        raise ValueError("block_rows and period must be positive")
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    columns = docs.columns
    # Rows travel as one struct: no name of theirs can meet one of ours, which all begin alike.
    sizes = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    shards = {s: max(-(-n // SHARD_ROWS), min(-(-n // SMALL_SHARD_ROWS), SMALL_SHARDS)) for s, n in sizes.items()}
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    blocks = [-(-sizes[s] // block_rows) for s in names]
    targets = flattened(sizes) if weights is None else weights
    found = phases(blocks, [float(targets.get(s) or 0) for s in names])

    schema = "mix_source int, mix_known boolean, mix_name string, mix_shards long"
    sources = _inlined(spark, [{"mix_source": i, "mix_known": s is not None, "mix_name": s or "", "mix_shards": shards[s]} for i, s in enumerate(names)], schema)
    sources = F.broadcast(sources) if len(names) <= SEND_SOURCES else sources
    few = sum(blocks) <= SEND_BLOCKS
    slots = slot_table(planned(spark, found), period)
    slots = slots.select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "chunk", "slots", "phases")])

    name = F.col(source_col).cast("string")
    order = [F.col(id_col), *[F.xxhash64(F.col(c)) for c in columns if c != id_col and "map<" not in dict(docs.dtypes)[c]]]
    key = ["mix_known", "mix_name"]
    keyed = docs.select(
        name.isNotNull().alias("mix_known"), F.coalesce(name, F.lit("")).alias("mix_name"), F.xxhash64(*order).alias("mix_hash"),
        order[0].alias("mix_id"), F.array(*order[1:]).cast("array<long>").alias("mix_rest"), F.struct(*columns).alias("mix_row"),
    )
    # The slots join only after the shuffles, so that rows don't carry them.
    keyed = keyed.join(sources, key).drop(*key).withColumn("mix_shard", F.pmod("mix_hash", "mix_shards"))
    key = ["mix_source"]
    # Where a shard's rows begin within their source.
    starts = keyed.groupBy(*key, "mix_shard").agg(F.count("*").alias("mix_n"))
    before = Window.partitionBy(*key).orderBy("mix_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*key, "mix_shard", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_start"))
    ranked = keyed.withColumn("mix_rank", F.row_number().over(Window.partitionBy(*key, "mix_shard").orderBy("mix_id", "mix_rest")) - 1)
    ranked = ranked.join(starts, [*key, "mix_shard"])
    row = F.col("mix_start") + F.col("mix_rank")
    ranked = ranked.withColumn("mix_block", F.floor(row / block_rows).cast("long")).withColumn("mix_at", F.pmod(row, F.lit(block_rows)))
    ranked = ranked.withColumn("mix_chunk", F.floor(F.col("mix_block") / period).cast("long"))
    ranked = ranked.join(F.broadcast(slots) if few else slots, [*key, "mix_chunk"])
    within = F.pmod("mix_block", F.lit(period)).cast("int")
    slot = F.get("mix_slots", within)
    return ranked.select(
        *[F.col("mix_row")[c].alias(c) for c in columns],
        "mix_block",
        F.get("mix_phases", within).alias("mix_phase"),
        slot.cast("long").alias("mix_slot"),
        (slot * block_rows + F.col("mix_at")).cast("long").alias("mix_place"),
    )


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all of them with all their columns, laid out in the order of the mix."""
    packed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.struct(*docs.columns).alias("doc"))
    placed = schedule(packed, weights, "id", "source", **options)
    return placed.repartitionByRange("mix_place").sortWithinPartitions("mix_place").select("doc.*")
