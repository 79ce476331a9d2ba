"""Queries of schedules and analyzers (K, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.hashing import uniform_int
from weftgraph.operators import analyzers as X
from weftgraph.operators import partition as P
from weftgraph.operators import sampling as N
from weftgraph.operators import schedule as K
from weftgraph.plans.base import query
from weftgraph.plans.graph import GRID, LANES, SWAPPED, batched, lanes
from weftgraph.plans.ingest import BUCKETS, EDGE_IDS, PARTS, STATES, bucketed, edges_with_ids
from weftgraph.sources import files
from weftgraph.sources.graphs import folded, n_vectors, sql_hash, table
from weftgraph.sources.shared import discard_on_exit, new_path


def schedule_table(spark: SparkSession, states) -> DataFrame:
    return P.states_table(spark, states)


def _sizes(spark: SparkSession, sf_dir: str, parts: int) -> list[int]:
    """Edges by bucket: parts * parts numbers."""
    rows = P.bucket_sizes(P.with_buckets(folded(spark, sf_dir), n_vectors(spark, sf_dir), parts), parts).collect()
    held = {r["bucket"]: r["n"] for r in rows}
    return [held[i] for i in range(parts * parts)]


def schedule_facts(spark: SparkSession, states) -> DataFrame:
    """What a schedule promises, as rows (fact, a, b): "met" for partitions a and b that are resident together, "size" for
    the b partitions of state a, "swaps" for the b partitions that state a admits."""
    rows = schedule_table(spark, states)
    met = P.covering(rows).select(F.lit("met").alias("fact"), F.col("src_part").alias("a"), F.col("dst_part").alias("b")).distinct()
    sizes = rows.groupBy("state").agg(F.countDistinct("part").alias("b")).select(F.lit("size").alias("fact"), F.col("state").alias("a"), F.col("b").cast("int").alias("b"))
    old = rows.select((F.col("state") + 1).alias("state"), "part")
    fresh = rows.where("state > 0").join(old, ["state", "part"], "left_anti").groupBy("state").agg(F.count(F.lit(1)).alias("b")).select(F.lit("swaps").alias("fact"), F.col("state").alias("a"), F.col("b").cast("int").alias("b"))
    return met.unionByName(sizes).unionByName(fresh).select("fact", F.col("a").cast("int").alias("a"), "b")


def swap_facts(parts: int, groups: int, slots: int, capacity: int, swapped: int) -> str:
    """SQL of the facts of a one-swap order of groups: all pairs meet, and each state admits one group. A pass goes
    through the groups that wait, then fills the other slots with some of them."""
    return f"""WITH RECURSIVE passes AS (SELECT {groups - slots} AS waiting, 1 AS n UNION ALL SELECT waiting - least({slots - 1}, waiting), n + waiting + least({slots - 1}, waiting) FROM passes WHERE waiting > 0), k AS (SELECT max(n) AS n FROM passes)
SELECT 'met' AS fact, CAST(x.a AS INTEGER) AS a, CAST(y.b AS INTEGER) AS b FROM range({parts}) x(a), range({parts}) y(b) UNION ALL SELECT 'size', CAST(s AS INTEGER), {capacity} FROM range((SELECT n FROM k)) t(s) UNION ALL SELECT 'swaps', CAST(s AS INTEGER), {swapped} FROM range(1, (SELECT n FROM k)) t(s)"""


@query(swap_facts(16, 16, 4, 4, 1))
def k1_one_swap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule_facts(spark, K.order_buckets("BETA", 16, 4))


@query(swap_facts(16, 7, 3, 8, 2))
def k2_two_level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two, one of which is pinned: three of the other seven groups are resident at once."""
    return schedule_facts(spark, K.order_buckets("COMET", 16, 8, ratio=2, pinned=1))


@query("SELECT a AS src_part, b AS dst_part, CASE WHEN a = b THEN 5 ELSE 1 END AS n_states FROM range(16) x(a), range(16) y(b)")
def k3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 16 partitions, every pair is resident in exactly one state and each partition in five."""
    rows = P.covering(schedule_table(spark, K.cover(16))).groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n_states"))
    return rows.select(F.col("src_part").cast("long").alias("src_part"), F.col("dst_part").cast("long").alias("dst_part"), F.col("n_states").cast("int").alias("n_states"))


COVER_ROWS = ", ".join(f"({s}, {p})" for s, own in enumerate(K.cover(16)) for p in own)
COVERED = f"st AS (SELECT * FROM (VALUES {COVER_ROWS}) t(state, part)), met AS (SELECT a.part AS src_part, b.part AS dst_part, a.state FROM st a JOIN st b ON a.state = b.state)"


@query(f"WITH {COVERED} SELECT src_part, dst_part, min(state) AS state FROM met GROUP BY ALL")
def k4_greedy_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.assign_buckets(schedule_table(spark, K.cover(16)))


@query(f"WITH {COVERED}, r AS (SELECT *, row_number() OVER (PARTITION BY src_part, dst_part ORDER BY {sql_hash(chr(39) + 'own' + chr(39), 'src_part', 'dst_part', 'state')}, state) AS n FROM met) SELECT src_part, dst_part, state FROM r WHERE n = 1")
def k5_random_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.covering(schedule_table(spark, K.cover(16)))
    draw = F.struct(uniform_int("own", F.col("src_part"), F.col("dst_part"), F.col("state")).alias("h"), "state")
    return rows.groupBy("src_part", "dst_part").agg(F.min(draw).alias("x")).select("src_part", "dst_part", "x.state")


@query()
def k6_optimized_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the cover of 16 partitions in four lanes before and after its partitions are dealt anew."""
    sizes = _sizes(spark, sf_dir, 16)
    before = K.score(range(16), K.cover(16), sizes, 16, 4, 1000)
    _, after = K.optimize(sizes, 16, lanes=4, batch=1000)
    names = ["worst_round_spread", "worst_batch_spread", "worst_state_weight", "total_round_spread", "admitted_hotness", "admitted", "deviation"]
    return spark.createDataFrame([(n, int(a), int(b)) for n, a, b in zip(names, before, after, strict=True)], "measure string, before long, after long")


@query("SELECT CAST(s // 4 AS INTEGER) AS round, 4 AS n_lanes, CAST(s AS INTEGER) AS state FROM range(20) t(s)")
def k7_lane_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each state is worked on once, in its round, by a lane of its own."""
    states = K.cover(16)
    path, _, _ = K.lane_orders([list(range(i, i + 4)) for i in range(0, 20, 4)], states, K.hotness(_sizes(spark, sf_dir, 16), 16))
    rows = spark.createDataFrame([(r, lane, s) for r, own in enumerate(path) for lane, s in enumerate(own)], "round int, lane int, state int")
    return rows.join(rows.groupBy("round").agg(F.countDistinct("lane").cast("int").alias("n_lanes")), "round").select("round", "n_lanes", "state")


@query(f"WITH {BUCKETS}, st AS (SELECT * FROM (VALUES {', '.join(f'({s}, {p})' for s, own in enumerate(STATES) for p in own)}) t(state, part)), w AS (SELECT a.state, count(*) AS weight FROM st a JOIN st b ON a.state = b.state JOIN bucketed ON src_part = a.part AND dst_part = b.part GROUP BY a.state) SELECT CAST(state // 2 AS INTEGER) AS round FROM w GROUP BY 1 ORDER BY max(weight), sum(weight), 1 LIMIT 1")
def k8_startup_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rounds of two states, by resident weight."""
    sizes = _sizes(spark, sf_dir, PARTS)
    weights = [K.resident_weight(s, sizes, PARTS) for s in STATES]
    return spark.createDataFrame([(K.startup_round([[0, 1], [2, 3], [4, 5]], weights, [0] * len(STATES)),)], "round int")


def group_facts(spark: SparkSession, groups, states) -> DataFrame:
    """superstep, n_states, n_parts (distinct partitions of its states) of groups of states."""
    rows = spark.createDataFrame([(i, s, p) for i, own in enumerate(groups) for s in own for p in states[s]], "superstep int, state int, part int")
    return rows.groupBy("superstep").agg(F.countDistinct("state").cast("int").alias("n_states"), F.countDistinct("part").cast("int").alias("n_parts"))


DISJOINT = "SELECT CAST(s AS INTEGER) AS superstep, 4 AS n_states, 16 AS n_parts FROM range(5) t(s)"


@query(DISJOINT)
def k9_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four states a superstep that share no partition."""
    return group_facts(spark, K.supersteps(K.cover(16), 4) or [], K.cover(16))


@query(DISJOINT)
def k10_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = K.cover(16)
    return group_facts(spark, K.regroup(K.supersteps(states, 4) or [], states, _sizes(spark, sf_dir, 16), 16), states)


@query("SELECT 'met' AS fact, CAST(x.a AS INTEGER) AS a, CAST(y.b AS INTEGER) AS b FROM range(8) x(a), range(8) y(b)")
def k11_access_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs meet (tests look at lanes and at what each step brings)."""
    return schedule_facts(spark, K.access_aware(8, 4, 2)).where("fact = 'met'")


@query("SELECT CAST(p AS INTEGER) AS part, true AS resident FROM range(16) t(p)")
def k12_dispersed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition is resident at some time."""
    return schedule_table(spark, K.dispersed(16, 4)).select("part", F.lit(True).alias("resident")).distinct()


@query("SELECT CAST(p AS INTEGER) AS slot, p < 3 AS trains, true AS distinct_part FROM range(5) t(p)")
def k13_sequential_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five resident partitions of ten; of 1000 nodes the first 250 train, so that partitions 0 to 2 come first."""
    rows = schedule_table(spark, K.sequential(250, 1000, 10, 5))
    seen = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(seen, "part").select("slot", (F.col("part") == F.col("slot")).alias("trains"), (F.col("n") == 1).alias("distinct_part"))


@query(f"WITH {SWAPPED}, {LANES}, s AS (SELECT step AS superstep, lane, list(part) AS parts FROM lanes GROUP BY ALL), p AS (SELECT a.superstep, len([x FOR x IN a.parts IF list_contains(b.parts, x)]) AS n FROM s a JOIN s b ON a.superstep = b.superstep AND a.lane < b.lane) SELECT superstep, CAST(sum((n > 0)::INT) AS BIGINT) AS conflicts, max(n) AS max_overlap, round(avg(n), 6) AS mean_overlap FROM p GROUP BY superstep")
def x1_superstep_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes(spark).select(F.col("step").alias("superstep"), F.col("lane").alias("state"), "part")
    return X.superstep_overlap(rows).withColumn("mean_overlap", F.round("mean_overlap", 6))


POSITIONED = f"{BUCKETS}, placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY src, rel, dst) - 1 AS place FROM bucketed)"


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.places_in_buckets(bucketed(spark, sf_dir), ["src", "rel", "dst"])


@query(f"WITH {POSITIONED}, s AS (SELECT * FROM placed WHERE place % 65536 % 4 = 0), ends AS (SELECT bucket, src AS node FROM s UNION ALL SELECT bucket, dst FROM s) SELECT bucket, count(*) // 2 AS n_edges, count(DISTINCT node) AS n_nodes FROM ends GROUP BY bucket")
def x2_bucket_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ends in a sample of every fourth edge of each bucket."""
    sample = positioned(spark, sf_dir).where(X.stride(F.col("at"), 4, 65536))
    ends = sample.select("bucket", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("bucket").agg((F.count(F.lit(1)) / 2).cast("long").alias("n_edges"), F.countDistinct("node").alias("n_nodes"))


@query(f"WITH {POSITIONED}, s AS (SELECT * FROM placed WHERE place % 65536 % 2 = 0), c AS (SELECT node AS key, count(*) AS n FROM (SELECT src AS node FROM s UNION ALL SELECT dst FROM s) GROUP BY node), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS nth, sum(n) OVER () AS total FROM c) SELECT CAST(any_value(total) AS BIGINT) AS total, count(*) AS n_keys, round(sum(CASE WHEN nth <= 10 THEN n END) / any_value(total), 6) AS top_10, round(sum(CASE WHEN nth <= 100 THEN n END) / any_value(total), 6) AS top_100 FROM r")
def x3_hot_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = positioned(spark, sf_dir).where(X.stride(F.col("at"), 2, 65536))
    counts = sample.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = X.coverage(counts, [10, 100])
    return rows.select("total", "n_keys", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


TOUCHED = f"{EDGE_IDS}, {GRID}, touched AS (SELECT DISTINCT batch, CAST(node // s AS INTEGER) AS part, node % s AS row FROM (SELECT batch, src AS node FROM batched UNION ALL SELECT batch, dst FROM batched), (SELECT CAST(ceil(n / {PARTS}.0) AS BIGINT) AS s FROM nv))"


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.touches(batched(spark, sf_dir), P.partition_size(n_vectors(spark, sf_dir), PARTS))


@query(f"WITH {TOUCHED}, r AS (SELECT part, row, count(*) AS n FROM touched GROUP BY ALL) SELECT part, CAST(sum(n) AS BIGINT) AS touches, count(*) AS distinct_rows, round(1 - count(*) / sum(n), 6) AS duplicate_ratio, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS repeated_fraction, count(DISTINCT row // 64) AS blocks_64, count(DISTINCT row // 256) AS blocks_256, count(DISTINCT row // 1024) AS blocks_1024, count(DISTINCT row // 4096) AS blocks_4096 FROM r GROUP BY part")
def x4_touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.touch_summary(touched(spark, sf_dir))
    return rows.select("part", "touches", "distinct_rows", F.round("duplicate_ratio", 6).alias("duplicate_ratio"), F.round("repeated_fraction", 6).alias("repeated_fraction"), "blocks_64", "blocks_256", "blocks_1024", "blocks_4096")


@query(f"WITH {TOUCHED}, c AS (SELECT part, row, count(*) AS n FROM touched GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, row) AS nth FROM c) SELECT part, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_keys, round(sum(CASE WHEN nth <= 256 THEN n ELSE 0 END) / sum(n), 6) AS top_256, round(sum(CASE WHEN nth <= 1024 THEN n ELSE 0 END) / sum(n), 6) AS top_1024, round(sum(CASE WHEN nth <= 4096 THEN n ELSE 0 END) / sum(n), 6) AS top_4096 FROM r GROUP BY part")
def x4_touch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a partition's touches that its most touched rows take."""
    counts = touched(spark, sf_dir).groupBy("part", "row").agg(F.count(F.lit(1)).alias("n"))
    rows = X.coverage(counts, [256, 1024, 4096], by=["part"])
    return rows.select("part", "total", "n_keys", *[F.round(c, 6).alias(c) for c in ("top_256", "top_1024", "top_4096")])


@query(f"WITH {TOUCHED}, g AS (SELECT *, row - row_number() OVER (PARTITION BY batch, part ORDER BY row) AS k FROM touched), r AS (SELECT batch, part, k, count(*) AS length FROM g GROUP BY ALL) SELECT part, count(*) AS n_runs, max(length) AS longest, round(avg(length), 6) AS mean_length FROM r GROUP BY part")
def x4_row_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring rows that a batch touches."""
    rows = X.runs(touched(spark, sf_dir), ["batch", "part"], "row")
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"))


@query(f"WITH {TOUCHED}, h AS (SELECT batch, part, block, row // block AS at, count(*) AS n FROM touched, (VALUES (64), (256), (1024), (4096)) b(block) GROUP BY ALL) SELECT part, block, count(*) AS n_blocks, round(avg(n / block), 6) AS fill FROM h GROUP BY ALL")
def x4_block_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.block_fill(touched(spark, sf_dir)).select("part", "block", "n_blocks", F.round("fill", 6).alias("fill"))


@query(f"WITH {TOUCHED}, g AS (SELECT part, batch - lag(batch) OVER (PARTITION BY part, row ORDER BY batch) AS gap FROM touched) SELECT part, horizon, count(*) AS n, CAST(sum(coalesce(gap <= horizon, false)::INT) AS BIGINT) AS captured FROM g, (VALUES (1), (2), (4), (8), (16)) t(horizon) GROUP BY ALL")
def x4_captured_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.captured(touched(spark, sf_dir))


@query(f"WITH {TOUCHED}, g AS (SELECT part, batch - lag(batch) OVER (PARTITION BY part, row ORDER BY batch) AS gap FROM touched) SELECT part, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def x4_revisit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.revisit_gaps(touched(spark, sf_dir))


@query(f"WITH {SWAPPED}, {LANES}, g AS (SELECT DISTINCT lane, part, step FROM lanes), i AS (SELECT *, step - row_number() OVER (PARTITION BY lane, part ORDER BY step) AS k FROM g) SELECT lane, part, min(step) AS first, count(*) AS length FROM i GROUP BY lane, part, k")
def x4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.segments(lanes(spark))


@query(f"WITH {SWAPPED}, {LANES}, h AS (SELECT a.step, a.lane, a.part, max(CASE WHEN b.lane = a.lane THEN 2 WHEN b.lane IS NOT NULL THEN 1 ELSE 0 END) AS how FROM lanes a LEFT JOIN lanes b ON b.step = a.step - 1 AND b.part = a.part WHERE a.step > 0 GROUP BY ALL) SELECT step, CAST(sum((how = 2)::INT) AS BIGINT) AS retained, CAST(sum((how = 1)::INT) AS BIGINT) AS moved, CAST(sum((how = 0)::INT) AS BIGINT) AS loaded FROM h GROUP BY step")
def x5_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.handoff(lanes(spark))


@query(f"WITH {EDGE_IDS}, {GRID}, ends AS (SELECT batch, src AS node FROM batched UNION ALL SELECT batch, dst FROM batched) SELECT batch, count(*) AS n_ids, count(DISTINCT node) AS n_unique, 0::BIGINT AS mismatches FROM ends GROUP BY batch")
def x6_unique_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique ids of each captured batch with the inverse checked: batches, ids, distinct ids and mismatches."""
    path = new_path(spark)
    batches = N.batches(N.shuffle_edges(edges_with_ids(spark, sf_dir)), 1000)
    files.capture(batches.select("batch", F.posexplode(F.array("src", "dst")).alias("_end", "id"), "row").select("batch", (F.col("row") * 2 + F.col("_end")).alias("at"), "id"), path)
    discard_on_exit(spark, path)
    ends = files.replay(spark, path)
    unique = ends.select("batch", "id").distinct().withColumn("inverse", F.row_number().over(Window.partitionBy("batch").orderBy("id")) - 1)
    back = ends.join(unique, ["batch", "id"]).join(unique.select("batch", "inverse", F.col("id").alias("found")), ["batch", "inverse"])
    return back.groupBy("batch").agg(F.count(F.lit(1)).alias("n_ids"), F.countDistinct("inverse").alias("n_unique"), F.sum(F.when(F.col("id") != F.col("found"), 1).otherwise(0)).cast("long").alias("mismatches"))


@query("SELECT event_type AS metric, round(avg(value) FILTER (WHERE event_id % 2 = 0), 6) AS mean_a, round(stddev_samp(value) FILTER (WHERE event_id % 2 = 0), 6) AS std_a, round(avg(value) FILTER (WHERE event_id % 2 = 1), 6) AS mean_b, round(stddev_samp(value) FILTER (WHERE event_id % 2 = 1), 6) AS std_b, round((avg(value) FILTER (WHERE event_id % 2 = 1) - avg(value) FILTER (WHERE event_id % 2 = 0)) / abs(avg(value) FILTER (WHERE event_id % 2 = 0)) * 100, 6) AS change_percent FROM events GROUP BY event_type")
def x7_compare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants' measurements, read back from lines of a log."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("variant"), F.col("event_type").alias("metric"), "value")
    found = X.compare_logs(rows)
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("mean_a", "std_a", "mean_b", "std_b", "change_percent")])


@query("SELECT event_type AS metric, event_id % 7 + 0.5 AS value, count(*) AS n FROM events GROUP BY ALL")
def x7_parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("[info] "), "event_type", F.lit(": "), (F.col("event_id") % 7 + 0.5).cast("string")).alias("line"))
    cleaned = lines.select(F.regexp_replace("line", r"^\[info\] ", "").alias("line"))
    return X.parse_log(cleaned).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
