"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Words are runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased. An
item's windows are ``window`` consecutive words; an item of fewer words, but not none,
is one window. Each window is a set of shingles of ``shingle`` words (of all its words,
if it has fewer).

1. *Rarity*: every occurrence of an item's shingle in any document is counted. A window
   with a shingle that no document has can't occur and goes.
2. *Prefix*: a document that holds a window holds all its shingles, so the prefix that
   must be joined is one shingle, the window's rarest. Documents' shingles meet the
   prefixes where the documents are read, by a broadcast of at most ``BLOCK_ROWS`` rows;
   more windows than that are joined in blocks, one pass over the documents each.
3. *Bounds and verification*: the place of the prefix in the document and in the window
   gives the window's place; it must lie within the document (length and positional
   bounds), and the document's words there must equal the window's.

Only verified windows and one row a document are shuffled, equal ones added up first.
Items that share a window share a set of items, which is listed once; documents with the
same sets share the union.

Defined results: null and empty texts have no words and are clean; an item without words
has no window; an item with a null id marks words as hit but is no item; a repeated item
id is one item with the windows of all its rows; each row of a repeated document id is
judged by its own text; a null document id stays null; an empty table of documents gives
an empty table, an empty table of items leaves all clean; other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import staged

WINDOW, SHINGLE = 10, 5
#: Rows of windows or shingles that are sent to every task at once: some 60 MB.
BLOCK_ROWS = 200_000
#: Sets of items that are sent to the documents that hold several.
SEND_SETS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text column, in order; of null none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _GAP), "")


def _shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + i) for i in range(size)])


def _placed(docs: DataFrame, sizes: list[int], head: bool) -> DataFrame:
    """A row for each place and shingle size of ``docs`` (with ``words``, ``n_words``): ``at``, ``h``.

    With ``head`` each document also has a row with ``at`` -1 and a null ``h``.
    """
    n = F.col("n_words").cast("int") * len(sizes)
    places = F.sequence(F.lit(-1), n - 1) if head else F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = docs.select("*", F.explode(places).alias("g"))
    at = F.col("g") if len(sizes) == 1 else F.when(F.col("g") < 0, -1).otherwise(F.expr(f"cast(g div {len(sizes)} as int)"))
    rows = rows.withColumn("at", at)
    h = F.lit(None).cast("long")
    for j, size in enumerate(sizes):
        here = (F.col("g") >= 0) & (F.col("at") + size <= F.col("n_words"))
        h = F.when(here & (F.pmod("g", F.lit(len(sizes))) == j), _shingle_hash(F.col("words"), F.col("at"), size)).otherwise(h)
    return rows.withColumn("h", h)


def _blocks(table: DataFrame, rows: int) -> list[DataFrame]:
    """``table`` (with ``h``) in blocks of about ``BLOCK_ROWS`` rows, to be broadcast one by one."""
    n = max(1, -(-rows // BLOCK_ROWS))
    return [table] if n == 1 else [table.filter(F.pmod(F.xxhash64("h"), F.lit(n)) == i) for i in range(n)]


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: ``window`` (its words), ``items`` (sorted ids as strings)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    rows = items.filter(F.size("words") > 0).select("item", "words", F.explode(starts).alias("s"))
    rows = rows.select("item", F.slice("words", F.col("s") + 1, window).alias("window"))
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """The windows that can occur with their rarest shingle ``h`` and its place ``off``, and the shingle sizes."""
    size = F.least(F.size("window"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size.alias("m")).distinct().collect())  # at most ``shingle`` numbers
    if not sizes:
        return windows.select("*", F.lit(0).cast("long").alias("h"), F.lit(0).alias("off")), [shingle]
    own = windows.select("window", F.explode(F.sequence(F.lit(0), F.size("window") - size)).alias("off"))
    h = reduce(lambda out, m: F.when(size == m, _shingle_hash(F.col("window"), F.col("off"), m)).otherwise(out), sizes, F.lit(None).cast("long"))
    own = staged(own.withColumn("h", h), "decon-shingles")
    known = own.select("h").distinct()
    places = _placed(docs, sizes, head=False).select("h")
    parts = [places.join(F.broadcast(block), "h").groupBy("h").agg(F.count("*").alias("n")) for block in _blocks(known, own.count())]
    seen = reduce(DataFrame.union, parts)
    # A window with a shingle that no document has gets a null count, which sorts first.
    counted = own.join(seen, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("p"))
    kept = counted.filter("p.n > 0").select("window", "p.off", "p.h")
    return staged(windows.join(kept, "window"), "decon-prefixes"), sizes


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """One row a document: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window, ``n_items`` the items
    with occurring windows, whose ids, sorted as strings, ``items_sha256`` digests.
    """
    if window < 1 or shingle < 1 or shingle > window:
        raise ValueError("1 <= shingle <= window is needed")
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tkey"), words_of(text).alias("words"))
    own = own.select("*", F.size("words").cast("long").alias("n_words"))
    windows = item_windows(benchmark, item_col, item_text_col, window)
    windows = windows.select("window", "items", F.sha2(F.concat_ws(",", "items"), 256).alias("set_id"))
    windows = staged(windows, "decon-windows")
    ready, sizes = prefixes(own, windows.select("window", "set_id"), shingle)
    hits = None
    for i, block in enumerate(_blocks(ready, ready.count())):
        met = _placed(own, sizes, head=i == 0).join(F.broadcast(block), "h", "left" if i == 0 else "inner")
        start = F.col("at") - F.col("off")
        inside = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
        holds = inside & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window"))
        met = met.filter((F.col("at") < 0) | F.coalesce(holds, F.lit(False)))
        met = met.select("id", "tkey", "n_words", start.alias("start"), (start + F.size("window")).alias("stop"), "set_id")
        hits = met if hits is None else hits.union(met)
    hits = staged(hits.groupBy("id", "tkey", "n_words", "start", "stop", "set_id").agg(F.count("*").alias("rows")), "decon-hits")

    doc = Window.partitionBy("id", "tkey").orderBy("start", "stop")
    before = F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))
    spans = hits.select("id", "tkey", "n_words", "start", "stop", "set_id", "rows").withColumn("fresh", fresh)
    per_doc = spans.groupBy("id", "tkey").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("start").isNull(), F.col("rows"))).alias("rows"),
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("set_id")).alias("sets"),
    )
    per_doc = staged(per_doc.withColumn("combo", F.sha2(F.concat_ws(",", "sets"), 256)), "decon-docs")
    # Documents with the same sets of items share the union, which is made once.
    combos = per_doc.filter(F.size("sets") > 0).groupBy("combo").agg(F.first("sets").alias("sets"))
    members = combos.select("combo", F.explode("sets").alias("set_id")).join(windows.select("set_id", "items").dropDuplicates(["set_id"]), "set_id")
    items = members.select("combo", F.explode_outer("items").alias("item")).distinct().groupBy("combo").agg(F.sort_array(F.collect_list("item")).alias("items"))
    items = staged(items.select("combo", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "decon-items")
    items = F.broadcast(items) if items.count() <= SEND_SETS else items
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return per_doc.select("*", copies.alias("copy")).join(items, "combo", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
