"""Queries of sources, sinks, dictionaries, splits and partitions (S, P)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.hashing import uniform_int
from weftgraph.functions.ranking import shuffled_positions
from weftgraph.functions.vectors import total
from weftgraph.operators import dictionary as D
from weftgraph.operators import partition as P
from weftgraph.operators import schedule as K
from weftgraph.plans.base import query
from weftgraph.sources import files
from weftgraph.sources.graphs import FOLDED, PURCHASES, SUPPLIES, VECTORS, folded, folded_in_order, n_vectors, purchases, sql_hash, sql_order, supplies, table, vectors
from weftgraph.sources.shared import discard_on_exit, new_path

PARTS = 4


@query(f"WITH {PURCHASES} SELECT src, rel, dst FROM kg")
def s1_delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with columns permuted to (src, dst, rel) and read by places (0, 2, 1)."""
    path = new_path(spark, "tsv")
    purchases(spark, sf_dir).select("src", "dst", "rel").write.option("sep", "\t").csv(path)
    discard_on_exit(spark, path)
    return files.scan(spark, path, "TSV", columns=(0, 2, 1))


@query("SELECT n_nationkey AS src, n_regionkey AS dst FROM nation")
def s2_array_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")).toArrow()
    return files.scan(spark, list(zip(*held.to_pydict().values(), strict=True)), "NUMPY", names=("src", "dst")).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query(f"WITH {SUPPLIES} SELECT 'p' || src AS src, 's' || dst AS dst FROM cooc")
def s5_strip_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with four lines each before their edges."""
    path = new_path(spark, "txt")
    rows = supplies(spark, sf_dir).select(F.concat(F.lit("p"), "src", F.lit("\t"), F.lit("s"), "dst").alias("line"))

    def headed(batches):
        head = pa.RecordBatch.from_arrays([pa.array(["# about"] * 4)], names=["line"])
        for i, batch in enumerate(batches):
            if i == 0:
                yield head
            yield batch

    rows.mapInArrow(headed, "line string").write.text(path)
    discard_on_exit(spark, path)
    return files.scan(spark, path, "TXT", columns=(0, 1), header=4)


@query(f"""WITH {PURCHASES}, n AS (SELECT count(*) AS n FROM kg),
placed AS (SELECT row_number() OVER (ORDER BY {sql_order("'split'", 'src', 'rel', 'dst')}, src, rel, dst) - 1 AS place FROM kg)
SELECT (SELECT count(*) FROM (SELECT src FROM kg UNION SELECT dst FROM kg)) AS n_nodes, (SELECT count(DISTINCT rel) FROM kg) AS n_relations,
 (SELECT count(*) FROM placed, n WHERE place < floor(n * 0.9)) AS n_train, (SELECT count(*) FROM placed, n WHERE place >= floor(n * 0.9) AND place < floor(n * 0.9) + floor(n * 0.05)) AS n_valid,
 (SELECT count(*) FROM placed, n WHERE place >= floor(n * 0.9) + floor(n * 0.05)) AS n_test""")
def s7_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = purchases(spark, sf_dir)
    split = D.split_edges(kg, (0.9, 0.05, 0.05), ["src", "rel", "dst"])
    count = lambda s: F.sum(F.when(F.col("split") == s, 1).otherwise(0)).alias(f"n_{s}")
    return D.node_universe(kg).agg(F.count(F.lit(1)).alias("n_nodes")).join(D.relation_universe(kg).agg(F.count(F.lit(1)).alias("n_relations"))).join(split.agg(count("train"), count("valid"), count("test")))


EDGE_IDS = f"{FOLDED}, ids AS (SELECT row_number() OVER (ORDER BY src, rel, dst) - 1 AS edge_id, src, rel, dst FROM vec)"


def edges_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, order = folded_in_order(spark, sf_dir)
    return files.with_edge_ids(edges, order).select("src", "rel", "dst", "edge_id")


@query(f"WITH {EDGE_IDS} SELECT edge_id, src, rel, dst FROM ids WHERE edge_id >= 1000 AND edge_id < 1500")
def s8_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_range(edges_with_ids(spark, sf_dir), 1000, 500)


@query("SELECT event_id AS at, vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS x, label FROM events, (SELECT count(*) AS n FROM embeddings), embeddings WHERE vec_id = user_id % n")
def s11_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), (F.col("user_id") % n_vectors(spark, sf_dir)).alias("id"))
    return files.gather(ids, vectors(spark, sf_dir)).select("at", "id", F.round(total(F.col("emb")), 6).alias("x"), "label")


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS value FROM customer")
def s12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of one segment doubled."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), "c_mktsegment")
    changes = rows.where("c_mktsegment = 'BUILDING'").withColumn("value", F.col("value") * 2)
    return files.upsert(rows.drop("c_mktsegment"), changes, ["value"])


@query(f"""WITH {FOLDED}, {VECTORS}, deltas AS (SELECT src AS id, i, sum(emb[i]) AS x FROM vec JOIN emb ON dst = id, range(1, 65) t(i) GROUP BY ALL)
SELECT emb.id, i, round(emb.emb[i] + coalesce(x, 0), 6) AS x FROM emb CROSS JOIN range(1, 65) t(i) LEFT JOIN deltas USING (id, i)""")
def s13_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the vectors of the nodes that their edges go to added."""
    rows = vectors(spark, sf_dir).select("id", "emb")
    deltas = folded(spark, sf_dir).join(rows.select(F.col("id").alias("dst"), F.col("emb").alias("delta")), "dst").select(F.col("src").alias("id"), "delta")
    return files.accumulate(rows, deltas).select("id", F.posexplode("emb").alias("i", "x")).select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT event_type AS label, CAST(event_id AS VARCHAR) AS id, value AS score FROM events")
def s15_score_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and labels written as text with a header, and read back."""
    path = new_path(spark, "csv")
    files.write_scores(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), path)
    discard_on_exit(spark, path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("event_type").alias("label"), F.col("event_id").alias("id"), F.col("value").cast("double").alias("score"))


@query(f"WITH {FOLDED} SELECT pos // 1000 AS batch, CAST(pos % 1000 AS INTEGER) AS at, src AS id FROM (SELECT row_number() OVER (ORDER BY src, rel, dst) - 1 AS pos, src FROM vec)")
def s18_capture_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of batches of edges in their order, written and read back."""
    path = new_path(spark)
    rows = edges_with_ids(spark, sf_dir)
    files.capture(rows.select(F.floor(F.col("edge_id") / 1000).cast("long").alias("batch"), F.pmod("edge_id", F.lit(1000)).cast("int").alias("at"), F.col("src").alias("id")), path)
    discard_on_exit(spark, path)
    return files.replay(spark, path)


@query(f"WITH nv AS (SELECT count(*) AS n FROM embeddings), size AS (SELECT CAST(ceil(n / {PARTS}.0) AS BIGINT) AS s FROM nv) SELECT vec_id AS id, label FROM embeddings, size WHERE vec_id // s IN (1, 3)")
def s14_partition_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two resident partitions."""
    n = n_vectors(spark, sf_dir)
    rows = vectors(spark, sf_dir).withColumn("part", P.partition_of(F.col("id"), n, PARTS))
    return rows.where(F.col("part").isin(1, 3)).select("id", "label")


@query(f"WITH {PURCHASES} SELECT src AS raw FROM kg UNION SELECT dst FROM kg UNION SELECT 's:' || s_suppkey FROM supplier")
def p2_node_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("raw"))
    return D.node_universe(purchases(spark, sf_dir), known)


@query(f"WITH {PURCHASES} SELECT DISTINCT rel AS raw FROM kg")
def p3_relation_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.relation_universe(purchases(spark, sf_dir))


COOC_NODES = f"{SUPPLIES}, nodes AS (SELECT src AS raw FROM cooc UNION SELECT dst FROM cooc)"


@query(f"WITH {COOC_NODES} SELECT raw, row_number() OVER (ORDER BY {sql_order(chr(39) + 'nodes' + chr(39), 'raw')}, raw) - 1 AS id FROM nodes")
def p4_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dense_ids(D.node_universe(supplies(spark, sf_dir)))


KG_NODES = f"{PURCHASES}, nodes AS (SELECT src AS raw FROM kg UNION SELECT dst FROM kg)"
KG_IDS = f"{KG_NODES}, ids AS (SELECT raw, row_number() OVER (ORDER BY {sql_order(chr(39) + 'nodes' + chr(39), 'raw')}, raw) - 1 AS id FROM nodes), relids AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM (SELECT DISTINCT rel AS raw FROM kg))"


@query(f"WITH {KG_IDS} SELECT raw, id FROM ids")
def p5_string_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dense_ids(D.node_universe(purchases(spark, sf_dir)))


COOC_TRAIN = f"split AS (SELECT *, row_number() OVER (ORDER BY {sql_order(chr(39) + 'split' + chr(39), 'src', 'dst')}, src, dst) - 1 AS place, count(*) OVER () AS n FROM cooc), train AS (SELECT * FROM split WHERE place < floor(n * 0.01))"


@query(f"WITH {COOC_NODES}, {COOC_TRAIN} SELECT raw, row_number() OVER (ORDER BY raw NOT IN (SELECT src FROM train UNION SELECT dst FROM train), {sql_order(chr(39) + 'nodes' + chr(39), 'raw')}, raw) - 1 AS id FROM nodes")
def p6_train_first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few training edges (a hundredth), so that some nodes have none."""
    edges = supplies(spark, sf_dir)
    train = D.split_edges(edges, (0.01, 0.99), ["src", "dst"]).where("split = 'train'")
    return D.train_first_ids(D.node_universe(edges), train)


@query(f"""WITH {COOC_NODES}, deg AS (SELECT raw, count(*) AS d FROM (SELECT src AS raw FROM cooc UNION ALL SELECT dst FROM cooc) GROUP BY raw),
top AS (SELECT raw, row_number() OVER (ORDER BY d DESC, raw) AS r FROM deg)
SELECT raw, row_number() OVER (ORDER BY r > 100, CASE WHEN r <= 100 THEN r END, {sql_order(chr(39) + 'nodes' + chr(39), 'raw')}, raw) - 1 AS id FROM top""")
def p7_degree_first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.degree_first_ids(supplies(spark, sf_dir), 100)


@query(f"WITH {KG_IDS} SELECT a.id AS src, r.id AS rel, b.id AS dst FROM kg JOIN ids a ON src = a.raw JOIN ids b ON dst = b.raw JOIN relids r ON rel = r.raw")
def p8_apply_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = purchases(spark, sf_dir)
    return D.apply_mapping(kg, D.dense_ids(D.node_universe(kg)), D.sorted_ids(D.relation_universe(kg)))


@query(f"WITH {COOC_NODES}, ids AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM nodes) SELECT id AS node, p_size AS size FROM part JOIN ids ON p_partkey = raw")
def p9_external_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of another source mapped through the dictionary."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("size"))
    return D.remap_ids(rows, D.sorted_ids(D.node_universe(supplies(spark, sf_dir))))


@query("WITH ids AS (SELECT c_custkey AS id FROM customer) SELECT id, coalesce(label, -1) AS label FROM ids LEFT JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id)")
def p10_pad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return D.pad_labels(nodes, vectors(spark, sf_dir).select("id", "label"))


SPLIT3 = f"""WITH {PURCHASES}, placed AS (SELECT *, row_number() OVER (ORDER BY {sql_order("'split'", 'src', 'rel', 'dst')}, src, rel, dst) - 1 AS place, count(*) OVER () AS n FROM kg)
SELECT src, rel, dst, CASE WHEN place < floor(n * 0.9) THEN 'train' WHEN place < floor(n * 0.9) + floor(n * 0.05) THEN 'valid' ELSE 'test' END AS split FROM placed"""


@query(SPLIT3)
def p11_split_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_edges(purchases(spark, sf_dir), (0.9, 0.05, 0.05), ["src", "rel", "dst"])


@query(f"""WITH {SUPPLIES}, placed AS (SELECT *, row_number() OVER (ORDER BY {sql_order("'split'", 'src', 'dst')}, src, dst) - 1 AS place, count(*) OVER () AS n FROM cooc)
SELECT src, dst, CASE WHEN place < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed""")
def p11_split_two_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_edges(supplies(spark, sf_dir), (0.8, 0.2), ["src", "dst"])


@query(f"WITH {SUPPLIES} SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM cooc")
def p12_cast_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplies(spark, sf_dir).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(event_id % 10 AS INTEGER) END AS label FROM events")
def p13_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 10).cast("double"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), D.no_label(raw).alias("label"))


SIZED = f"{FOLDED}, size AS (SELECT n, CAST(ceil(n / {PARTS}.0) AS BIGINT) AS s FROM nv)"
BUCKETS = f"{SIZED}, bucketed AS (SELECT src, rel, dst, CAST(src // s AS INTEGER) AS src_part, CAST(dst // s AS INTEGER) AS dst_part, CAST(src // s * {PARTS} + dst // s AS INTEGER) AS bucket FROM vec, size)"


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_buckets(folded(spark, sf_dir), n_vectors(spark, sf_dir), PARTS)


@query(f"WITH {BUCKETS} SELECT * FROM bucketed")
def p14_edge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir)


RESIDENT = "resident AS (SELECT * FROM (VALUES (0, 2), (1, 0), (2, 3)) t(slot, part))"


@query(f"WITH {SIZED}, {RESIDENT} SELECT CAST(part AS INTEGER) AS part, id AS node, row_number() OVER (ORDER BY slot, id) - 1 AS local FROM (SELECT vec_id AS id FROM embeddings), size JOIN resident ON part = id // s")
def p15_listed_local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    resident = P.states_table(spark, [(2, 0, 3)]).select("slot", "part")
    return P.dense_local_ids(resident, P.partition_table(spark, n_vectors(spark, sf_dir), PARTS))


@query(f"WITH {BUCKETS}, {RESIDENT} SELECT src, rel, dst, a.slot * s + src % s AS local_src, b.slot * s + dst % s AS local_dst FROM bucketed, size JOIN resident a ON a.part = src_part JOIN resident b ON b.part = dst_part")
def p16_arithmetic_local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    resident = P.states_table(spark, [(2, 0, 3)]).select("slot", "part")
    return P.arithmetic_local_ids(folded(spark, sf_dir), resident, n_vectors(spark, sf_dir), PARTS)


@query(f"WITH {SIZED}, perm AS (SELECT vec_id AS raw, row_number() OVER (ORDER BY {sql_order(chr(39) + 'perm' + chr(39), 'vec_id')}, vec_id) - 1 AS id FROM embeddings) SELECT CAST(a.id // s * {PARTS} + b.id // s AS INTEGER) AS bucket, count(*) AS n FROM vec JOIN perm a ON src = a.raw JOIN perm b ON dst = b.raw, size GROUP BY 1")
def p17_permuted_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    perm = shuffled_positions(vectors(spark, sf_dir).select(F.col("id").alias("raw")), ["raw"], "perm", "id")
    moved = D.apply_mapping(folded(spark, sf_dir), perm)
    return P.with_buckets(moved, n_vectors(spark, sf_dir), PARTS).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FOLDED} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS negative, CAST(sum((src >= n // 2)::INT + (dst >= n // 2)::INT) AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS missing FROM vec, nv")
def p18_check_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.check_ids(folded(spark, sf_dir), n_vectors(spark, sf_dir) // 2)


STATES = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
STATE_ROWS = ", ".join(f"({s}, {i}, {p})" for s, own in enumerate(STATES) for i, p in enumerate(own))
SQL_STATES = f"states AS (SELECT * FROM (VALUES {STATE_ROWS}) t(state, slot, part))"
SQL_OWNERS = f"{SQL_STATES}, owners AS (SELECT a.part AS src_part, b.part AS dst_part, min(a.state) AS state FROM states a JOIN states b ON a.state = b.state GROUP BY ALL)"


@query(f"WITH {BUCKETS}, {SQL_OWNERS} SELECT src, rel, dst FROM bucketed JOIN owners USING (src_part, dst_part) WHERE state = 1")
def p19_active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = P.assign_buckets(P.states_table(spark, STATES))
    return P.active_edges(bucketed(spark, sf_dir), owned, 1).select("src", "rel", "dst")


SWAPS = K.one_swap(8, 4, seed=3)
SWAP_ROWS = ", ".join(f"({s}, {p})" for s, own in enumerate(SWAPS) for p in own)


@query(f"""WITH st AS (SELECT state, list_sort(list(part)) AS parts FROM (VALUES {SWAP_ROWS}) t(state, part) GROUP BY state),
met AS (SELECT b.state, list_sort([x FOR x IN b.parts IF list_contains(a.parts, x)]) AS kept, list_sort([x FOR x IN b.parts IF NOT list_contains(a.parts, x)]) AS admitted, list_sort([x FOR x IN a.parts IF NOT list_contains(b.parts, x)]) AS evicted, len(b.parts) AS n FROM st a JOIN st b ON b.state = a.state + 1)
SELECT state, array_to_string(kept, ' ') AS kept, array_to_string(admitted, ' ') AS admitted, array_to_string(evicted, ' ') AS evicted, len(kept) * len(kept) AS kept_buckets, n * n - len(kept) * len(kept) AS fetched_buckets FROM met""")
def p20_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.state_changes(P.states_table(spark, SWAPS))
    return rows.select("state", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("kept", "admitted", "evicted")], "kept_buckets", "fetched_buckets")


@query(f"WITH {SUPPLIES} SELECT src, dst, {sql_hash(chr(39) + 'h' + chr(39), 'src', 'dst')} AS h FROM cooc")
def hash_uniform_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded hash that all random choices come from."""
    return supplies(spark, sf_dir).withColumn("h", uniform_int("h", F.col("src"), F.col("dst")))
