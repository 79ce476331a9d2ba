"""What a schedule, an access log or an epoch's log says about overlap, reuse and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def degree_offsets(edges: DataFrame, nodes: DataFrame, by: str = "src") -> DataFrame:
    """id, degree, offset: the place of each node's first edge when edges are sorted by ``by`` (nodes: id, dense).

    The sum over all smaller ids runs over 4096 blocks of ids first and then inside each block.
    """
    block = -(-((nodes.agg(F.max("id")).first()[0] or 0) + 1) // 4096)
    counts = edges.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    rows = nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.floor(F.col("id") / block).cast("long").alias("_block"))
    sums = rows.groupBy("_block").agg(F.sum("degree").alias("_n"))
    before = sums.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("degree").over(Window.partitionBy("_block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inner", inner).join(F.broadcast(before), "_block").select("id", "degree", (F.col("_before") + F.col("_inner")).alias("offset"))  # 4096 rows at most


def superstep_overlap(schedule: DataFrame) -> DataFrame:
    """superstep, conflicts, max_overlap, mean_overlap of the partitions of its states, pair by pair (superstep, state,
    part)."""
    sets = schedule.groupBy("superstep", "state").agg(F.collect_set("part").alias("parts"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.superstep") == F.col("b.superstep")) & (F.col("a.state") < F.col("b.state")))
    shared = F.size(F.array_intersect("a.parts", "b.parts"))
    return pairs.groupBy(F.col("a.superstep").alias("superstep")).agg(F.sum(F.when(shared > 0, 1).otherwise(0)).alias("conflicts"), F.max(shared).cast("long").alias("max_overlap"), F.avg(shared).alias("mean_overlap"))


def smallest_hashes(rows: DataFrame, by: Sequence[str], hashed: Column, k: int) -> DataFrame:
    """``by``, h: the k smallest distinct hashes of each group. Windows keep k rows in every task before the shuffle."""
    distinct = rows.select(*by, hashed.alias("h")).distinct()
    return distinct.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("_n") <= k).drop("_n")


def sketch_estimate(sketch: DataFrame, by: Sequence[str], k: int, space: float = 2.0**32) -> DataFrame:
    """``by``, estimate: exact below k hashes, else (k - 1) over the share of the space that they take."""
    found = sketch.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("h").alias("_last"))
    return found.select(*by, F.when(F.col("_n") < k, F.col("_n").cast("double")).otherwise((k - 1) * space / F.col("_last")).alias("estimate"))


def merge_sketches(sketch: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return smallest_hashes(sketch, by, F.col("h"), k)


def sketch_overlap(sketch: DataFrame, key: str) -> DataFrame:
    """a, b, overlap of each pair of groups: common hashes over the smaller sketch."""
    sizes = sketch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    left, right = sketch.select(F.col(key).alias("a"), "h"), sketch.select(F.col(key).alias("b"), "h")
    common = left.join(right, "h").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    out = common.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("common") / F.least("na", "nb")).alias("overlap"))


def coverage(counts: DataFrame, tops: Sequence[int], fractions: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """A row for each ``by`` (one without): total, n_keys and the share of all accesses (key, n) that the most frequent
    keys take.

    The sum of the greatest counts depends on how many keys have each count, of which there are few: the keys
    themselves are never ranked.
    """
    alike = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("_c"))
    later = Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.select(*by, "n", "_c", F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_keys"))
    wanted = [(f"top_{k}", F.lit(k)) for k in tops] + [(f"top_{f:g}_of_keys".replace(".", "_"), F.greatest(F.lit(1), F.floor(F.col("_keys") * f))) for f in fractions]
    taken = lambda k: F.col("n") * F.least("_c", F.greatest(k - F.col("_before"), F.lit(0)))
    total = F.sum(F.col("n") * F.col("_c"))
    return placed.groupBy(*by).agg(total.alias("total"), F.sum("_c").alias("n_keys"), *[(F.sum(taken(k)) / total).alias(name) for name, k in wanted])


def runs(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, first, length of each run of consecutive distinct values."""
    distinct = rows.select(*by, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return distinct.withColumn("_island", island).groupBy(*by, "_island").agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("length")).drop("_island")


def history_hits(accesses: DataFrame, history: int) -> DataFrame:
    """lane, step, n_keys, n_hits: keys of a step (lane, step, key) that one of the ``history`` steps before had."""
    distinct = accesses.select("lane", "step", "key").distinct()
    past = distinct.select("lane", "key", F.explode(F.sequence(F.col("step") + 1, F.col("step") + history)).alias("step")).distinct().withColumn("_hit", F.lit(1))
    return distinct.join(past, ["lane", "step", "key"], "left").groupBy("lane", "step").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.coalesce("_hit", F.lit(0))).cast("long").alias("n_hits"))


def reuse_within(schedule: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """horizon, n, reused of residencies (step, part) that come back within so many steps."""
    following = F.lead("step").over(Window.partitionBy("part").orderBy("step"))
    gaps = schedule.select("part", "step").distinct().withColumn("gap", following - F.col("step"))
    return gaps.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col("gap") <= h, F.lit(False)).cast("int").alias("hit")) for h in horizons])).alias("x")).groupBy("x.horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("reused"))


def handoff(schedule: DataFrame) -> DataFrame:
    """step, retained, moved, loaded: partitions of a superstep (step, lane, part) that stay in their lane, come from
    another lane of the step before, or from neither."""
    before = schedule.select((F.col("step") + 1).alias("step"), "part", F.col("lane").alias("old"))
    rows = schedule.where(F.col("step") > 0).join(before, ["step", "part"], "left").groupBy("step", "lane", "part").agg(F.max(F.when(F.col("old") == F.col("lane"), 2).when(F.col("old").isNotNull(), 1).otherwise(0)).alias("how"))
    count = lambda k: F.sum(F.when(F.col("how") == k, 1).otherwise(0)).alias({2: "retained", 1: "moved", 0: "loaded"}[k])
    return rows.groupBy("step").agg(count(2), count(1), count(0))


def segments(schedule: DataFrame) -> DataFrame:
    """lane, part, first, length: maximal runs of consecutive steps in which a partition stays in its lane."""
    return runs(schedule, ["lane", "part"], "step")


def stride(position: Column, s: int, restart: int | None = None) -> Column:
    """Whether a row is in the sample of every s-th row of its bucket, counted anew every ``restart`` rows."""
    return F.pmod(F.pmod(position, F.lit(restart)) if restart else position, F.lit(s)) == 0


def touches(batched: DataFrame, size: int) -> DataFrame:
    """batch, part, row: distinct ends of each batch's edges (batch, src, dst) by partition of ``size`` nodes."""
    ends = batched.select("batch", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.select("batch", F.floor(F.col("node") / size).cast("int").alias("part"), F.pmod("node", F.lit(size)).alias("row"))


def touch_summary(touched: DataFrame, blocks: Sequence[int] = (64, 256, 1024, 4096)) -> DataFrame:
    """part, touches, distinct_rows, duplicate_ratio and blocks_b: how many blocks of b rows hold a touched one."""
    by_row = touched.groupBy("part", "row").agg(F.count(F.lit(1)).alias("n"))
    held = by_row.groupBy("part").agg(F.sum("n").alias("touches"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("_again"), *[F.countDistinct(F.floor(F.col("row") / b)).alias(f"blocks_{b}") for b in blocks])
    return held.select("part", "touches", "distinct_rows", (1 - F.col("distinct_rows") / F.col("touches")).alias("duplicate_ratio"), (F.col("_again") / F.col("touches")).alias("repeated_fraction"), *[f"blocks_{b}" for b in blocks])


def block_fill(touched: DataFrame, blocks: Sequence[int] = (64, 256, 1024, 4096)) -> DataFrame:
    """part, block, n_blocks, fill: blocks of so many rows that a batch touches, and the mean share of their rows that
    it does touch."""
    sized = touched.select("batch", "part", "row", F.explode(F.array(*[F.lit(b) for b in blocks])).alias("block"))
    held = sized.groupBy("batch", "part", "block", F.floor(F.col("row") / F.col("block")).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    return held.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n_blocks"), F.avg(F.col("_n") / F.col("block")).alias("fill"))


def captured(touched: DataFrame, horizons: Sequence[int] = (1, 2, 4, 8, 16)) -> DataFrame:
    """part, horizon, n, captured: touches whose row was touched in one of so many batches before."""
    before = F.lag("batch").over(Window.partitionBy("part", "row").orderBy("batch"))
    gaps = touched.select("part", (F.col("batch") - before).alias("gap"))
    hit = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col("gap") <= h, F.lit(False)).cast("int").alias("hit")) for h in horizons])).alias("x")
    return gaps.select("part", hit).groupBy("part", "x.horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("captured"))


def revisit_gaps(touched: DataFrame) -> DataFrame:
    """part, gap, n: batches between touches of the same row."""
    before = F.lag("batch").over(Window.partitionBy("part", "row").orderBy("batch"))
    return touched.withColumn("gap", F.col("batch") - before).where("gap is not null").groupBy("part", "gap").agg(F.count(F.lit(1)).alias("n"))


def compare_logs(rows: DataFrame) -> DataFrame:
    """metric, mean and standard deviation of variants a and b (variant, metric, value), and the change in percent."""
    side = lambda v: F.when(F.col("variant") == v, F.col("value"))
    found = rows.groupBy("metric").agg(F.avg(side("a")).alias("mean_a"), F.stddev_samp(side("a")).alias("std_a"), F.avg(side("b")).alias("mean_b"), F.stddev_samp(side("b")).alias("std_b"))
    return found.withColumn("change_percent", F.when(F.col("mean_a") != 0, (F.col("mean_b") - F.col("mean_a")) / F.abs("mean_a") * 100))


def parse_log(lines: DataFrame) -> DataFrame:
    """metric, value of each "name: number" or "name = number" in a log's lines (line)."""
    found = F.regexp_extract_all("line", F.lit(r"([A-Za-z][A-Za-z0-9_@ ]*?)\s*[:=]\s*-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    split = lines.select(F.explode(found).alias("x"))
    return split.select(F.lower(F.trim(F.regexp_extract("x", r"^([^:=]*)", 1))).alias("metric"), F.regexp_extract("x", r"(-?[0-9]+(?:\.[0-9]+)?)$", 1).cast("double").alias("value"))
