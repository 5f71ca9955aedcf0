"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import staged


#: A key with at least one in this many rows is hot; so there are at most as many, or twice as many where links count both ways.
HOT = 1_000
#: Rows of a task of a small table, and the tasks that it has at least.
TASK_ROWS, TASKS = 20_000, 16


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows, in as many tasks as these need: where partitions are many, most of a small table's time is theirs."""
    return df.coalesce(max(TASKS, -(-rows // TASK_ROWS)))


def spread_join(rows: DataFrame, values: DataFrame, key: str, weight: str, how: str = "inner", hot: int = HOT, many: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``values``, which has a row a ``key`` and in ``weight`` how many rows it has.

    The values of keys with at least one in ``hot`` rows are sent to every task, so that
    such a key's rows meet theirs where they are; the others are joined by a shuffle. With ``how`` left,
    rows without a value, null keys too, stay. ``many``: how many rows there are at most, if that is known; else they are counted.
    """
    many = rows.count() if many is None else many
    bound = max(2, -(-many // hot))
    columns = [c for c in values.columns if c != key]
    sent = F.broadcast(values.filter(F.col(weight) >= bound).withColumn("is_hot", F.lit(True)))
    first = rows.join(sent, key, "left")
    done = first.filter("is_hot").select(*rows.columns, *columns)
    rest = first.filter("is_hot is null").select(*rows.columns)
    return small(done.union(rest.join(values.filter(F.col(weight) < bound), key, how).select(*rows.columns, *columns)), many)


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every end of ``links`` (``a``, ``b``); the root is the least node.

    A large-star links each greater neighbour of a node to the least of its
    neighbourhood, a small-star each lesser one; they alternate until nothing
    changes. The least neighbour is a partial aggregate, written so that it is made
    once, and hubs aren't shuffled for the join with it. Each round is written to the
    shared folder.
    """
    # A star has no more links than before; both ways there are twice as many.
    rows = 2 * links.count()
    now = staged(small(links.select("a", "b").filter("a <> b").distinct(), rows), "links")
    seen, many = None, rows // 2
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = staged(small(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), rows), "least")
        large = spread_join(both.filter("v > u"), least, "u", "n", many=many).select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        down = staged(small(down, rows), "stars")
        least = staged(small(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), rows), "least")
        less = spread_join(down, least, "u", "n", many=many).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        now = staged(small(less.filter("a <> b").distinct(), rows), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        # A greater neighbour is one of two ends, and a star has no more links than its greater neighbours.
        seen, many = state, state[0]
    return small(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()), rows)
