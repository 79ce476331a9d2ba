"""Dense positions over a whole table without gathering it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.hashing import digest
from weftgraph.sources.shared import cut

HEX = 3


def positions(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the position (from 0) of each row in ``order`` as a long.

    Rows are sorted by ranges and written; each range then adds the count of those before it. The driver's part is a
    row for each partition.
    """
    low = 33  # monotonically_increasing_id: partition in the bits from here up
    held = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", low).alias("_part")
    sizes = held.groupBy(part).agg(F.max("_at").alias("_last"))
    before = F.sum(F.col("_last").bitwiseAND(F.lit((1 << low) - 1)) + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = held.withColumn("_part", F.shiftright("_at", low)).join(F.broadcast(starts), "_part")  # a row for each partition
    return placed.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << low) - 1))).cast("long").alias(name))


def _head(seed: str, ids: list[str]) -> Column:
    """The first digits of a row's seeded hash, as a whole number."""
    return F.conv(F.substring(digest(seed, *[F.col(c) for c in ids]), 1, HEX), 16, 10).cast("int")


def shuffled_positions(df: DataFrame, ids: list[str], seed: str, name: str) -> DataFrame:
    """``df`` with each row's position in the order of the seeded hash of ``ids`` (ties by ids).

    The first digits of the hash part the order into 4096 ranges of about the same size, whatever the ids are.
    """
    head = _head(seed, ids)
    headed = df.withColumn("_head", head)
    sizes = headed.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_head", F.coalesce(before, F.lit(0)).alias("_before"))
    hashed = headed.repartition("_head").withColumn("_hash", digest(seed, *[F.col(c) for c in ids]))  # made anew, as moving it costs more
    within = F.row_number().over(Window.partitionBy("_head").orderBy("_hash", *ids))
    placed = hashed.withColumn("_within", within).join(F.broadcast(starts), "_head")  # 4096 rows at most
    return placed.select(*df.columns, (F.col("_before") + F.col("_within") - 1).cast("long").alias(name))


def shuffled_from(df: DataFrame, ids: list[str], seed: str, first: int) -> DataFrame:
    """The rows whose place in ``shuffled_positions`` is ``first`` at least: all of the ranges behind the one that has
    this place, which alone is ranked."""
    headed = df.withColumn("_head", _head(seed, ids))
    before = 0
    for head, n in sorted(tuple(r) for r in headed.groupBy("_head").agg(F.count(F.lit(1))).collect()):  # 4096 rows at most
        if before + n > first:
            break
        before += n
    else:
        return df.limit(0)
    within = F.row_number().over(Window.partitionBy("_head").orderBy(digest(seed, *[F.col(c) for c in ids]), *ids))
    own = headed.where(F.col("_head") == head).withColumn("_within", within).where(F.col("_within") > first - before)
    return headed.where(F.col("_head") > head).select(*df.columns).unionByName(own.select(*df.columns))


def places_within(df: DataFrame, keys: list[str], order: str, name: str, width: int = 1 << 18) -> DataFrame:
    """``df`` with each row's place (from 0) among the rows of its ``keys``, by the whole number ``order``.

    Rows are ranked inside ranges of ``width`` values and offset by the counts of earlier ranges, so that a key that
    holds a large part of all rows is ranked by many tasks.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width).cast("long"))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order)) - 1
    return ranged.withColumn("_within", within).join(starts, [*keys, "_range"]).select(*df.columns, (F.col("_before") + F.col("_within")).cast("long").alias(name))
