"""Node partitions, edge buckets and buffer states (sets of partitions that are resident at once)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ranking import positions
from weftgraph.sources.shared import cut


def partition_size(n_nodes: int, parts: int) -> int:
    return math.ceil(n_nodes / parts)


def partition_of(node: Column, n_nodes: int, parts: int) -> Column:
    return F.floor(node / partition_size(n_nodes, parts)).cast("int")


def with_buckets(edges: DataFrame, n_nodes: int, parts: int) -> DataFrame:
    """``edges`` with src_part, dst_part and bucket (src_part * parts + dst_part)."""
    placed = edges.withColumn("src_part", partition_of(F.col("src"), n_nodes, parts)).withColumn("dst_part", partition_of(F.col("dst"), n_nodes, parts))
    return placed.withColumn("bucket", F.col("src_part") * parts + F.col("dst_part"))


def bucket_sizes(bucketed: DataFrame, parts: int) -> DataFrame:
    """bucket, n of all parts * parts buckets, empty ones included."""
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = bucketed.sparkSession.range(parts * parts).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sort_by_bucket(bucketed: DataFrame, parts: int, within: Sequence[str] = ("edge_id",)) -> DataFrame:
    """Edges laid out by bucket: each bucket's rows together, in order of ``within``."""
    return bucketed.repartitionByRange(parts * parts, "bucket").sortWithinPartitions("bucket", *within)


def partition_table(spark: SparkSession, n_nodes: int, parts: int) -> DataFrame:
    """part, start, size; the last partitions are cut short and may be empty, never negative."""
    size = partition_size(n_nodes, parts)
    return spark.createDataFrame([(p, p * size, max(0, min(size, n_nodes - p * size))) for p in range(parts)], "part int, start long, size long")


def states_table(spark: SparkSession, states: Sequence[Sequence[int]]) -> DataFrame:
    """state, slot, part of each resident partition."""
    return spark.createDataFrame([(s, i, p) for s, own in enumerate(states) for i, p in enumerate(own)], "state int, slot int, part int")


def dense_local_ids(resident: DataFrame, parts: DataFrame) -> DataFrame:
    """part, node, local: the ids of ``resident`` (slot, part) numbered on through all slots, by listing them."""
    listed = resident.join(F.broadcast(parts), "part").where("size > 0").select("slot", "part", "start", "size")
    starts = listed.alias("a").join(F.broadcast(listed.alias("b")), F.col("b.slot") < F.col("a.slot"), "left").groupBy("a.slot", "a.part", "a.start", "a.size").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("first"))
    return starts.select("part", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at", "node"), "first").select("part", "node", (F.col("first") + F.col("at")).cast("long").alias("local"))


def arithmetic_local_ids(edges: DataFrame, resident: DataFrame, n_nodes: int, parts: int) -> DataFrame:
    """``edges`` whose two partitions are in ``resident`` (slot, part), with local_src and local_dst: slot * size +
    offset. Slots before the last partition are full, so that this agrees with the listed ids if it comes last."""
    size = partition_size(n_nodes, parts)
    out = edges
    for end in ("src", "dst"):
        slots = resident.select(F.col("part").alias(f"{end}_part"), F.col("slot").alias(f"_{end}_slot"))
        out = out.withColumn(f"{end}_part", partition_of(F.col(end), n_nodes, parts)).join(F.broadcast(slots), f"{end}_part")  # a row for each slot
        out = out.withColumn(f"local_{end}", (F.col(f"_{end}_slot") * size + F.pmod(F.col(end), F.lit(size))).cast("long"))
    return out.select(*edges.columns, "local_src", "local_dst")


def assign_buckets(states: DataFrame) -> DataFrame:
    """src_part, dst_part, state: the first state that holds both partitions."""
    return covering(states).groupBy("src_part", "dst_part").agg(F.min("state").alias("state"))


def covering(states: DataFrame) -> DataFrame:
    """src_part, dst_part, state of every state that holds both partitions."""
    a, b = states.select("state", F.col("part").alias("src_part")), states.select("state", F.col("part").alias("dst_part"))
    return a.join(b, "state").select("src_part", "dst_part", "state")


def active_edges(bucketed: DataFrame, owners: DataFrame, state: int) -> DataFrame:
    """Edges of the buckets that ``state`` owns."""
    own = owners.where(F.col("state") == state).select("src_part", "dst_part")
    return bucketed.join(F.broadcast(own), ["src_part", "dst_part"], "left_semi")  # parts squared rows at most


def state_changes(states: DataFrame) -> DataFrame:
    """state, kept, admitted, evicted: sorted partitions against the state before, and kept_buckets and
    fetched_buckets of the next resident set."""
    sets = states.groupBy("state").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    before = sets.select((F.col("state") + 1).alias("state"), F.col("parts").alias("old"))
    both = sets.join(before, "state")
    kept = F.array_intersect("parts", "old")
    return both.select("state", F.array_sort(kept).alias("kept"), F.array_sort(F.array_except("parts", "old")).alias("admitted"), F.array_sort(F.array_except("old", "parts")).alias("evicted"), (F.size(kept) * F.size(kept)).cast("long").alias("kept_buckets"), (F.size("parts") * F.size("parts") - F.size(kept) * F.size(kept)).cast("long").alias("fetched_buckets"))


def check_ids(edges: DataFrame, n_nodes: int) -> DataFrame:
    """rows, negative, too_large, missing: counts of ids of ``edges`` outside 0..n_nodes-1."""
    ends = [F.col("src"), F.col("dst")]
    count = lambda test: sum((F.sum(F.when(test(c), 1).otherwise(0)) for c in ends), F.lit(0)).cast("long")
    return edges.agg(F.count(F.lit(1)).alias("n_rows"), count(lambda c: c < 0).alias("negative"), count(lambda c: c >= n_nodes).alias("too_large"), count(lambda c: c.isNull()).alias("missing"))


def places_in_buckets(bucketed: DataFrame, order: Sequence[str], name: str = "at") -> DataFrame:
    """``bucketed`` with each edge's place in its bucket, by ``order``: its place among all edges less that of the
    bucket's first one."""
    placed = cut(positions(bucketed, ["bucket", *order], "_place"))
    first = placed.groupBy("bucket").agg(F.min("_place").alias("_first"))
    return placed.join(first, "bucket").select(*bucketed.columns, (F.col("_place") - F.col("_first")).alias(name))
