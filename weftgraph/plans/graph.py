"""Queries of joins, aggregations, windows, sorts and set operations (J, A, W, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V
from weftgraph.functions.hashing import uniform_int
from weftgraph.functions.ranking import positions, shuffled_positions
from weftgraph.operators import analyzers as X
from weftgraph.operators import dictionary as D
from weftgraph.operators import messages as E
from weftgraph.operators import partition as P
from weftgraph.operators import sampling as N
from weftgraph.operators import scoring as S
from weftgraph.plans.base import query
from weftgraph.plans.ingest import BUCKETS, COOC_NODES, EDGE_IDS, SQL_OWNERS, SQL_STATES, STATES, SWAP_ROWS, SWAPS, bucketed, edges_with_ids
from weftgraph.sources.graphs import FOLDED, PURCHASES, RELATIONS, SUPPLIES, VECTORS, folded, n_vectors, purchases, relation_vectors, sql_hash, sql_order, supplies, table, vectors
from weftgraph.sources.shared import cut


@query(f"WITH {FOLDED}, {VECTORS} SELECT src, rel, dst, round(list_sum(a.emb), 6) AS src_total, round(list_sum(b.emb), 6) AS dst_total FROM vec JOIN emb a ON src = a.id JOIN emb b ON dst = b.id")
def j1_gather_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_ends(folded(spark, sf_dir), vectors(spark, sf_dir))
    return rows.select("src", "rel", "dst", F.round(V.total(F.col("src_emb")), 6).alias("src_total"), F.round(V.total(F.col("dst_emb")), 6).alias("dst_total"))


@query(f"WITH {FOLDED}, {VECTORS}, g AS (SELECT b AS batch, c AS chunk, s AS slot, {sql_hash(chr(39) + 'neg' + chr(39), 'b', 'c', 's')} % (SELECT count(*) FROM embeddings) AS node FROM range((SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM vec)) x(b), range(2) y(c), range(50) z(s)) SELECT batch, CAST(chunk AS INTEGER) AS chunk, CAST(slot AS INTEGER) AS slot, node, round(list_sum(emb), 6) AS x FROM g JOIN emb ON node = id")
def j2_gather_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred negatives for each batch of the table."""
    drawn = N.uniform_negatives(spark, n_batches(spark, sf_dir), 2, 50, n_vectors(spark, sf_dir))
    rows = drawn.join(vectors(spark, sf_dir).select(F.col("id").alias("node"), "emb"), "node")
    return rows.select("batch", "chunk", "slot", "node", F.round(V.total(F.col("emb")), 6).alias("x"))


@query(f"WITH {FOLDED}, {VECTORS} SELECT dst AS node, rel, count(*) AS n, round(sum(list_sum(emb)), 5) AS x FROM vec JOIN emb ON dst = id GROUP BY ALL")
def j3_deduplicated_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.gather_once(folded(spark, sf_dir).select(F.col("dst").alias("node"), "rel"), vectors(spark, sf_dir))
    rows = rows.select("node", "rel", V.total(F.col("emb")).alias("total"))
    return rows.groupBy("node", "rel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 5).alias("x"))


@query(f"WITH {FOLDED}, {RELATIONS} SELECT src, rel, dst, round(list_sum(r.vec), 6) AS forward, round(-list_sum(r.vec), 6) AS inverse FROM vec JOIN rels r USING (rel)")
def j4_relation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.with_relation(folded(spark, sf_dir), relation_vectors(spark))
    return rows.select("src", "rel", "dst", F.round(V.total(F.col("rel_vec")), 6).alias("forward"), F.round(-V.total(F.col("rel_vec")), 6).alias("inverse"))


@query(f"WITH {EDGE_IDS}, q AS (SELECT vec_id AS node FROM embeddings) SELECT node, coalesce(min(edge_id), -1) AS first, coalesce(max(edge_id) + 1, -1) AS past FROM q LEFT JOIN ids ON src = node GROUP BY node")
def j5_edge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of sorted edge ids of each node."""
    asked = vectors(spark, sf_dir).select(F.col("id").alias("src"))
    ranges = edges_with_ids(spark, sf_dir).groupBy("src").agg(F.min("edge_id").alias("first"), (F.max("edge_id") + 1).alias("past"))
    return asked.join(ranges, "src", "left").select(F.col("src").alias("node"), F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("past", F.lit(-1)).alias("past"))


GRID = f"pos AS (SELECT *, row_number() OVER (ORDER BY {sql_order(chr(39) + 'shuffle' + chr(39), 'edge_id')}, edge_id) - 1 AS pos FROM ids), batched AS (SELECT *, pos // 1000 AS batch, CAST(pos % 1000 AS INTEGER) AS row, CAST(pos % 1000 // 250 AS INTEGER) AS chunk FROM pos)"
N_NEG = 10
NEG = f"neg AS (SELECT b AS batch, CAST(c AS INTEGER) AS chunk, CAST(s AS INTEGER) AS slot, {sql_hash(chr(39) + 'neg' + chr(39), 'b', 'c', 's')} % (SELECT n FROM nv) AS node FROM range((SELECT max(batch) + 1 FROM batched)) x(b), range(4) y(c), range({N_NEG}) z(s))"
CAND = f"{EDGE_IDS}, {GRID}, {NEG}, cand AS (SELECT batched.batch, row, edge_id, src, rel, dst, slot, node FROM batched JOIN neg USING (batch, chunk))"


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.batches(N.shuffle_edges(edges_with_ids(spark, sf_dir)), 1000)


def n_batches(spark: SparkSession, sf_dir: str) -> int:
    return -(-folded(spark, sf_dir).count() // 1000)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each edge, shared by the 250 edges of its chunk."""
    drawn = N.uniform_negatives(spark, n_batches(spark, sf_dir), 4, N_NEG, n_vectors(spark, sf_dir))
    return N.candidates(batched(spark, sf_dir), drawn, 250).select("batch", "row", "edge_id", "src", "rel", "dst", "slot", "node")


@query(f"WITH {CAND} SELECT batch, row, slot, node FROM cand WHERE NOT EXISTS (SELECT 1 FROM vec WHERE vec.src = cand.src AND vec.rel = cand.rel AND vec.dst = cand.node)")
def j6_drop_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.drop_known(candidates(spark, sf_dir), folded(spark, sf_dir)).select("batch", "row", "slot", "node")


@query(f"WITH {CAND} SELECT batch, row, slot, node FROM cand WHERE NOT EXISTS (SELECT 1 FROM batched b WHERE b.batch = cand.batch AND b.src = cand.src AND b.rel = cand.rel AND b.dst = cand.node)")
def j7_drop_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.drop_local(candidates(spark, sf_dir), batched(spark, sf_dir)).select("batch", "row", "slot", "node")


DEG = f"sizes AS (SELECT batch, count(*) AS size FROM batched GROUP BY batch), deg AS (SELECT x.b AS batch, CAST(y.c AS INTEGER) AS chunk, CAST(z.s AS INTEGER) AS slot, CAST({sql_hash(chr(39) + 'deg' + chr(39), 'x.b', 'y.c', 'z.s')} % size AS INTEGER) AS sample_row FROM sizes JOIN (SELECT batch AS b FROM sizes) x ON batch = x.b, range(4) y(c), range(20) z(s))"


@query(f"WITH {EDGE_IDS}, {GRID}, {DEG} SELECT deg.batch, deg.chunk, slot, sample_row, dst AS node, sample_row // 250 = deg.chunk AS filtered FROM deg JOIN batched ON deg.batch = batched.batch AND sample_row = row")
def j8_degree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = N.degree_negatives(batched(spark, sf_dir), n_batches(spark, sf_dir), 4, 20)
    return drawn.withColumn("filtered", N.from_own_chunk(F.col("sample_row"), F.col("chunk"), 250))


ROOTS = "roots AS (SELECT vec_id AS root FROM embeddings)"
HOP = "SELECT {0} AS hop, root, node, edge_id, src, rel, dst, 'in' AS direction FROM {1} JOIN ids ON dst = node UNION ALL SELECT {0}, root, node, edge_id, src, rel, dst, 'out' FROM {1} JOIN ids ON src = node"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("id").alias("root"))


@query(f"WITH {EDGE_IDS}, {ROOTS}, f AS (SELECT root, root AS node FROM roots) SELECT root, node, edge_id, src, rel, dst, direction FROM ({HOP.format(0, 'f')})")
def j9_expand_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.neighbours(roots(spark, sf_dir).withColumn("node", F.col("root")), edges_with_ids(spark, sf_dir))


@query(f"WITH {FOLDED}, {ROOTS} SELECT root, dst AS node FROM roots JOIN vec ON src = root WHERE dst <> root GROUP BY ALL")
def j10_exclude_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = roots(spark, sf_dir).withColumn("node", F.col("root"))
    reached = N.neighbours(start, edges_with_ids(spark, sf_dir), incoming=False).select("root", F.col("dst").alias("node")).distinct()
    return reached.join(start, ["root", "node"], "left_anti")


@query(f"WITH {COOC_NODES}, ids AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM nodes) SELECT src, id FROM cooc JOIN ids ON src = raw")
def j11_search_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = supplies(spark, sf_dir)
    ids = D.sorted_ids(D.node_universe(edges))
    return edges.select("src").join(ids.withColumnRenamed("raw", "src"), "src")


EVAL = f"eval AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {sql_order(chr(39) + 'split' + chr(39), 'src', 'rel', 'dst')}, src, rel, dst) - 1 AS place, count(*) OVER () AS k FROM ids) WHERE place >= floor(k * 0.9) + floor(k * 0.05))"
SCORED = "query AS (SELECT edge_id, src, rel, dst, [a.emb[i] * r.vec[i] FOR i IN range(1, 65)] AS q FROM eval JOIN emb a ON src = a.id JOIN rels r USING (rel)), alls AS (SELECT edge_id, src, rel, dst, c.id AS node, round(list_dot_product(q, c.emb), 6) AS score FROM query, emb c), pos AS (SELECT edge_id, score AS pos FROM alls WHERE node = dst)"
RANKS = "ranks AS (SELECT edge_id, src, rel, dst, pos AS score, 1 + sum((alls.score >= pos AND NOT EXISTS (SELECT 1 FROM vec k WHERE k.src = alls.src AND k.rel = alls.rel AND k.dst = alls.node))::INT) AS rank FROM alls JOIN pos USING (edge_id) GROUP BY ALL)"


def evaluated(edges: DataFrame) -> DataFrame:
    """The test split of edges with ids."""
    return D.last_split(edges, (0.9, 0.05, 0.05), ["src", "rel", "dst"])


@query(f"WITH {EDGE_IDS}, {VECTORS}, {RELATIONS}, {EVAL}, {SCORED}, {RANKS} SELECT edge_id, src, rel, dst, score, CAST(rank AS BIGINT) AS rank FROM ranks")
def j12_all_candidates_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered ranks of the test edges among all nodes."""
    edges = edges_with_ids(spark, sf_dir)
    return S.filtered_ranks(evaluated(edges), vectors(spark, sf_dir), relation_vectors(spark), edges)


@query(f"WITH {CAND} SELECT batch, row, slot, node FROM cand")
def j13_chunk_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("batch", "row", "slot", "node")


LANES = "lanes AS (SELECT state // 2 AS step, state % 2 AS lane, part FROM states)"


def lanes(spark: SparkSession) -> DataFrame:
    rows = P.states_table(spark, SWAPS)
    return rows.select(F.floor(F.col("state") / 2).cast("int").alias("step"), (F.col("state") % 2).alias("lane"), "part")


SWAPPED = f"states AS (SELECT state, part FROM (VALUES {SWAP_ROWS}) t(state, part))"


@query(f"WITH {SWAPPED}, {LANES} SELECT a.step, a.lane, a.part, coalesce(min(b.lane), -1) AS owner FROM lanes a LEFT JOIN lanes b ON b.step = a.step - 1 AND b.part = a.part GROUP BY ALL")
def j14_current_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lane that held each partition one step before."""
    now = lanes(spark)
    before = now.select((F.col("step") + 1).alias("step"), "part", F.col("lane").alias("old"))
    return now.join(before, ["step", "part"], "left").groupBy("step", "lane", "part").agg(F.coalesce(F.min("old"), F.lit(-1)).alias("owner"))


@query(f"WITH {PURCHASES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM kg UNION ALL SELECT dst, 0, 1 FROM kg) GROUP BY node")
def a1_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.node_degrees(purchases(spark, sf_dir))


@query(f"WITH {FOLDED}, d AS (SELECT vec_id AS id, count(src) AS degree FROM embeddings LEFT JOIN vec ON src = vec_id GROUP BY vec_id) SELECT id, degree, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM d")
def a2_csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.degree_offsets(folded(spark, sf_dir), vectors(spark, sf_dir))


@query(f"WITH {FOLDED}, size AS (SELECT CAST(ceil(n / 64.0) AS BIGINT) AS s FROM nv), placed AS (SELECT src // s * 64 + dst // s AS k FROM vec, size) SELECT CAST(b AS INTEGER) AS bucket, count(k) AS n FROM range(4096) t(b) LEFT JOIN placed ON k = b GROUP BY b")
def a3_bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 64 partitions, so that some buckets are empty."""
    return P.bucket_sizes(P.with_buckets(folded(spark, sf_dir), n_vectors(spark, sf_dir), 64), 64)


@query("SELECT event_id, user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS inverse FROM events")
def a4_unique_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    unique = positions(rows.select("user_id").distinct(), ["user_id"], "inverse")
    return rows.join(unique, "user_id").select("event_id", "user_id", "inverse")


@query("SELECT user_id AS value, count(*) AS n FROM events GROUP BY user_id")
def a6_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {COOC_NODES}, ids AS (SELECT raw, row_number() OVER (ORDER BY raw) - 1 AS id FROM nodes) SELECT src, dst, a.id AS src_id, b.id AS dst_id FROM cooc JOIN ids a ON src = a.raw JOIN ids b ON dst = b.raw")
def a7_joint_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = supplies(spark, sf_dir)
    ids = D.sorted_ids(D.node_universe(edges))
    return edges.join(ids.select(F.col("raw").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("raw").alias("dst"), F.col("id").alias("dst_id")), "dst").select("src", "dst", "src_id", "dst_id")


DIM = 64


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folded(spark, sf_dir).join(vectors(spark, sf_dir).drop("label").withColumnRenamed("id", "dst"), "dst")
    return rows.select(F.col("src").alias("seg"), F.col("emb").alias("vec"))


def _unfold(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.posexplode("vec").alias("i", "x")).select(key, (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {FOLDED}, {VECTORS} SELECT src AS seg, i, round(sum(emb[i]), 6) AS x FROM vec JOIN emb ON dst = id, range(1, 65) t(i) GROUP BY ALL")
def a8_segment_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.segment_sum(_segments(spark, sf_dir), DIM), "seg")


@query(f"WITH {FOLDED}, {VECTORS} SELECT src AS seg, i, round(max(emb[i]), 6) AS x FROM vec JOIN emb ON dst = id, range(1, 65) t(i) GROUP BY ALL")
def a9_segment_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.segment_max(_segments(spark, sf_dir), DIM), "seg")


@query(f"WITH {FOLDED}, {VECTORS}, rows AS (SELECT src AS seg, rel, dst, emb[1] * 5 AS x FROM vec JOIN emb ON dst = id), own AS (SELECT id AS seg, emb[2] * 5 AS self_x FROM emb), tot AS (SELECT seg, sum(exp(x)) + any_value(exp(self_x)) AS t FROM rows JOIN own USING (seg) GROUP BY seg) SELECT seg, rel, dst, round(exp(x) / t, 6) AS weight FROM rows JOIN tot USING (seg)")
def a10_segment_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = vectors(spark, sf_dir)
    rows = folded(spark, sf_dir).join(emb.select(F.col("id").alias("dst"), (F.element_at("emb", 1) * 5).alias("x")), "dst").withColumnRenamed("src", "seg")
    own = emb.select(F.col("id").alias("seg"), (F.element_at("emb", 2) * 5).alias("self_x"))
    return E.segment_softmax(rows, own).select("seg", "rel", "dst", F.round("weight", 6).alias("weight"))


@query("SELECT l_partkey AS id, sum(l_quantity) AS delta, count(*) AS n FROM lineitem GROUP BY l_partkey")
def a11_reduce_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("delta"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {FOLDED}, {VECTORS}, g AS (SELECT src AS node, dst AS other FROM vec UNION ALL SELECT dst, src FROM vec) SELECT node AS seg, i, round(sum(emb[i]), 6) AS x FROM g JOIN emb ON other = id, range(1, 65) t(i) GROUP BY ALL")
def a12_gradient_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by node over both ends of edges (each end's gradient is the other's vector, as for a dot product)."""
    edges = folded(spark, sf_dir)
    both = edges.select(F.col("src").alias("seg"), F.col("dst").alias("id")).union(edges.select("dst", "src"))
    return _unfold(E.segment_sum(both.join(vectors(spark, sf_dir).drop("label"), "id").select("seg", F.col("emb").alias("vec")), DIM), "seg")


HITS = ", ".join(f"avg((rank <= {k})::INT) AS hits_{k}" for k in (1, 3, 5, 10, 50, 100))
REPORT = f"SELECT count(*) AS n_ranks, avg(rank) AS mean_rank, avg(1 / rank) AS mrr, {HITS} FROM ranks"


@query(f"WITH {EDGE_IDS}, {VECTORS}, {RELATIONS}, {EVAL}, {SCORED}, {RANKS} {REPORT}")
def link_prediction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank, MRR and hits of filtered link prediction (A13): the flagship."""
    return S.metrics(j12_all_candidates_ranks(spark, sf_dir))


@query(f"WITH {CAND}, {VECTORS}, sc AS (SELECT batch, row, edge_id, round(list_dot_product(a.emb, b.emb), 6) AS neg FROM cand JOIN emb a ON src = a.id JOIN emb b ON node = b.id), ps AS (SELECT edge_id, round(list_dot_product(a.emb, b.emb), 6) AS pos FROM ids JOIN emb a ON src = a.id JOIN emb b ON dst = b.id) SELECT edge_id, 1 + CAST(sum((neg >= pos)::INT) AS BIGINT) AS rank FROM sc JOIN ps USING (edge_id) GROUP BY edge_id")
def a14_sampled_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfiltered ranks among the negatives of the edge's chunk."""
    emb, rels = vectors(spark, sf_dir), relation_vectors(spark)
    neg = S.score_candidates(candidates(spark, sf_dir).select("edge_id", "src", "rel", "node"), emb, rels, "dot").select("edge_id", F.round("score", 6).alias("neg"))
    edges = edges_with_ids(spark, sf_dir).withColumnRenamed("dst", "node")
    pos = S.score_candidates(edges, emb, rels, "dot").select("edge_id", F.round("score", 6).alias("pos"))
    return neg.join(pos, "edge_id").groupBy("edge_id").agg((1 + F.sum(F.when(F.col("neg") >= F.col("pos"), 1).otherwise(0))).cast("long").alias("rank"))


@query(f"WITH {BUCKETS} SELECT part, CAST(sum(n) AS BIGINT) AS hotness FROM (SELECT src_part AS part, 1 AS n FROM bucketed UNION ALL SELECT dst_part, 1 FROM bucketed WHERE src_part <> dst_part) GROUP BY part")
def a15_partition_hotness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = bucketed(spark, sf_dir).select(F.explode(F.array_distinct(F.array("src_part", "dst_part"))).alias("part"))
    return ends.groupBy("part").agg(F.count(F.lit(1)).alias("hotness"))


@query(f"WITH {BUCKETS}, {SQL_OWNERS}, w AS (SELECT state, count(*) AS weight FROM bucketed JOIN owners USING (src_part, dst_part) GROUP BY state) SELECT state // 2 AS round, max(weight) - min(weight) AS spread, max(ceil(weight / 1000.0)) - min(ceil(weight / 1000.0)) AS batch_spread, round(sum(abs(weight - m)), 6) AS deviation FROM (SELECT *, avg(weight) OVER (PARTITION BY state // 2) AS m FROM w) GROUP BY 1")
def a16_round_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = P.assign_buckets(P.states_table(spark, STATES))
    weights = bucketed(spark, sf_dir).join(F.broadcast(owned), ["src_part", "dst_part"]).groupBy("state").agg(F.count(F.lit(1)).alias("weight"))
    by_round = weights.withColumn("round", F.floor(F.col("state") / 2).cast("int"))
    means = by_round.groupBy("round").agg(F.avg("weight").alias("mean"))
    batch_count = F.ceil(F.col("weight") / 1000).cast("double")
    return by_round.join(means, "round").groupBy("round").agg((F.max("weight") - F.min("weight")).alias("spread"), (F.max(batch_count) - F.min(batch_count)).alias("batch_spread"), F.round(F.sum(F.abs(F.col("weight") - F.col("mean"))), 6).alias("deviation"))


@query(f"WITH {BUCKETS}, {SQL_STATES} SELECT a.state, count(*) AS weight FROM states a JOIN states b ON a.state = b.state JOIN bucketed ON src_part = a.part AND dst_part = b.part GROUP BY a.state")
def a17_resident_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bucketed(spark, sf_dir).groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n"))
    return P.covering(P.states_table(spark, STATES)).join(sizes, ["src_part", "dst_part"]).groupBy("state").agg(F.sum("n").alias("weight"))


KMV = f"hashes AS (SELECT DISTINCT l_returnflag AS grp, {sql_hash(chr(39) + 'kmv' + chr(39), 'l_partkey')} AS h FROM lineitem), kept AS (SELECT grp, h FROM hashes QUALIFY row_number() OVER (PARTITION BY grp ORDER BY h) <= 256)"


def kmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.smallest_hashes(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_partkey"), ["grp"], uniform_int("kmv", F.col("l_partkey")), 256)


@query(f"WITH {KMV} SELECT grp, round(CASE WHEN count(*) < 256 THEN CAST(count(*) AS DOUBLE) ELSE 255 * 4294967296.0 / max(h) END, 6) AS estimate FROM kept GROUP BY grp")
def a18_distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sketch_estimate(kmv(spark, sf_dir), ["grp"], 256).select("grp", F.round("estimate", 6).alias("estimate"))


@query(f"WITH {KMV}, n AS (SELECT grp, count(*) AS n FROM kept GROUP BY grp) SELECT a.grp AS a, b.grp AS b, round(count(*) / least(any_value(x.n), any_value(y.n)), 6) AS overlap FROM kept a JOIN kept b ON a.h = b.h AND a.grp < b.grp JOIN n x ON x.grp = a.grp JOIN n y ON y.grp = b.grp GROUP BY ALL")
def a19_sketch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sketch_overlap(cut(kmv(spark, sf_dir)), "grp").select("a", "b", F.round("overlap", 6).alias("overlap"))


COVER_SQL = "WITH c AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, key) AS nth, sum(n) OVER () AS total, count(*) OVER () AS k FROM c) SELECT CAST(any_value(total) AS BIGINT) AS total, count(*) AS n_keys, round(sum(CASE WHEN nth <= 16 THEN n END) / any_value(total), 6) AS top_16, round(sum(CASE WHEN nth <= 64 THEN n END) / any_value(total), 6) AS top_64, round(sum(CASE WHEN nth <= greatest(1, floor(k * 0.1)) THEN n END) / any_value(total), 6) AS top_0_1_of_keys FROM r"


@query(COVER_SQL)
def a20_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rows = X.coverage(counts, [16, 64], [0.1])
    return rows.select("total", "n_keys", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY event_type")
def a21_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query(f"WITH {RELATIONS} SELECT round(avg(sqrt(list_dot_product(vec, vec))), 6) AS mean_norm FROM rels")
def a22_relation_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation_vectors(spark).agg(F.round(F.avg(F.sqrt(V.dot(F.col("vec"), F.col("vec")))), 6).alias("mean_norm"))


@query(f"WITH {VECTORS} SELECT id, CAST(list_position(emb, list_max(emb)) - 1 AS INTEGER) AS predicted, label FROM emb")
def a23_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", S.argmax(F.col("emb")).alias("predicted"), "label")


@query(f"WITH {VECTORS} SELECT round(avg((list_position(emb, list_max(emb)) - 1 = label)::INT), 6) AS accuracy FROM emb")
def a13_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accuracy(a23_argmax(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT user_id, n, CAST(coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def w1_exclusive_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"))
    rows = X.degree_offsets(users, users.distinct().withColumnRenamed("src", "id"))
    return rows.select(F.col("id").alias("user_id"), F.col("degree").alias("n"), "offset")


@query("SELECT DISTINCT l_partkey AS value, dense_rank() OVER (ORDER BY l_partkey) - 1 AS id FROM lineitem")
def w2_dense_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value")).distinct(), ["value"], "id")


@query(f"WITH {EDGE_IDS}, {GRID} SELECT batch, count(*) AS n, min(edge_id) AS least, max(edge_id) AS most FROM batched GROUP BY batch")
def w3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("least"), F.max("edge_id").alias("most"))


@query(f"WITH {EDGE_IDS}, {GRID} SELECT batch, row // 334 AS chunk, count(*) AS n FROM batched GROUP BY ALL")
def w4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks of a batch of 1000: no row is made up to fill the last one."""
    size = N.chunk_size(1000, 3)
    return batched(spark, sf_dir).groupBy("batch", F.floor(F.col("row") / size).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT DISTINCT event_type, user_id FROM events), g AS (SELECT *, user_id - row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS k FROM d) SELECT event_type, min(user_id) AS first, count(*) AS length FROM g GROUP BY event_type, k")
def w5_consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.runs(table(spark, sf_dir, "events"), ["event_type"], "user_id")


HIST = "acc AS (SELECT DISTINCT event_type AS lane, CAST(event_id // 500 AS INTEGER) AS step, user_id AS key FROM events)"


@query(f"WITH {HIST} SELECT lane, step, count(*) AS n_keys, CAST(sum(EXISTS (SELECT 1 FROM acc b WHERE b.lane = a.lane AND b.key = a.key AND b.step BETWEEN a.step - 3 AND a.step - 1)::INT) AS BIGINT) AS n_hits FROM acc a GROUP BY lane, step")
def w6_lane_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.floor(F.col("event_id") / 500).cast("int").alias("step"), F.col("user_id").alias("key"))
    return X.history_hits(rows, 3)


@query(f"WITH {SWAPPED}, g AS (SELECT part, state, lead(state) OVER (PARTITION BY part ORDER BY state) - state AS gap FROM states) SELECT horizon, count(*) AS n, CAST(sum(coalesce(gap <= horizon, false)::INT) AS BIGINT) AS reused FROM g, (VALUES (1), (2), (4), (8)) t(horizon) GROUP BY horizon")
def w7_lookahead_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.states_table(spark, SWAPS).select(F.col("state").alias("step"), "part")
    return X.reuse_within(rows, [1, 2, 4, 8])


@query(f"WITH {BUCKETS} SELECT bucket, src, rel, dst, row_number() OVER (PARTITION BY bucket ORDER BY src, dst, rel) - 1 AS at FROM bucketed")
def o1_sort_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.places_in_buckets(bucketed(spark, sf_dir).select("bucket", "src", "rel", "dst"), ["src", "dst", "rel"])


@query(f"WITH {EDGE_IDS} SELECT edge_id, row_number() OVER (ORDER BY {sql_order(chr(39) + 'shuffle' + chr(39), 'edge_id')}, edge_id) - 1 AS pos FROM ids")
def o2_seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_positions(edges_with_ids(spark, sf_dir).select("edge_id"), ["edge_id"], "shuffle", "pos")


@query(f"WITH {BUCKETS} SELECT bucket, src, rel, dst, row_number() OVER (ORDER BY bucket, src, rel, dst) - 1 AS at FROM bucketed")
def o3_bucket_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(bucketed(spark, sf_dir).select("bucket", "src", "rel", "dst"), ["bucket", "src", "rel", "dst"], "at")


SCORED_CAND = f"{CAND}, {VECTORS}, sc AS (SELECT batch, row, slot, node, round(list_dot_product(a.emb, b.emb), 6) AS score FROM cand JOIN emb a ON src = a.id JOIN emb b ON node = b.id)"


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the dot product with their source."""
    rows = S.score_candidates(candidates(spark, sf_dir), vectors(spark, sf_dir), relation_vectors(spark), "dot")
    return rows.select("batch", "row", "slot", "node", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED_CAND} SELECT batch, row, slot, node, score FROM sc QUALIFY row_number() OVER (PARTITION BY batch, row ORDER BY score DESC, slot) <= 5")
def o4_top_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.select_top(scored_candidates(spark, sf_dir), 5, ["batch", "row"]).drop("nth")


@query(f"WITH {SCORED_CAND} SELECT batch, row, slot, node, score FROM sc QUALIFY row_number() OVER (PARTITION BY batch, row, slot // 2 ORDER BY score DESC, slot) = 1")
def o5_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.select_tournament(scored_candidates(spark, sf_dir), N_NEG, 5, ["batch", "row"])


@query(f"WITH {SUPPLIES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM cooc UNION ALL SELECT dst FROM cooc) GROUP BY node ORDER BY degree DESC, node LIMIT 50")
def o7_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.node_degrees(supplies(spark, sf_dir)).select("node", "degree").orderBy(F.desc("degree"), "node").limit(50)


@query(f"WITH {PURCHASES}, {SUPPLIES} SELECT src, rel, dst FROM kg UNION ALL SELECT 'p:' || src, 'S', 's:' || dst FROM cooc")
def u1_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = supplies(spark, sf_dir).select(F.concat(F.lit("p:"), "src").alias("src"), F.lit("S").alias("rel"), F.concat(F.lit("s:"), "dst").alias("dst"))
    return purchases(spark, sf_dir).unionByName(other)


@query(f"WITH {FOLDED} SELECT src, rel, count(*) AS n FROM vec GROUP BY ALL")
def u2_filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits together, as the global filter takes them."""
    split = D.split_edges(folded(spark, sf_dir), (0.9, 0.05, 0.05), ["src", "rel", "dst"])
    parts = [split.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src", "rel").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SWAPPED} SELECT state, part, 'admit' AS change FROM states a WHERE state > 0 AND NOT EXISTS (SELECT 1 FROM states b WHERE b.state = a.state - 1 AND b.part = a.part) UNION ALL SELECT state + 1, part, 'evict' FROM states a WHERE state < (SELECT max(state) FROM states) AND NOT EXISTS (SELECT 1 FROM states b WHERE b.state = a.state + 1 AND b.part = a.part)")
def u3_admit_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.state_changes(P.states_table(spark, SWAPS))
    changed = lambda c, name: rows.select("state", F.explode(c).alias("part"), F.lit(name).alias("change"))
    return changed("admitted", "admit").unionByName(changed("evicted", "evict"))


@query(f"WITH {SQL_STATES} SELECT a.state AS a, b.state AS b, count(x.part) AS shared, count(x.part) = 0 AS disjoint FROM (SELECT DISTINCT state FROM states) a JOIN (SELECT DISTINCT state FROM states) b ON a.state < b.state LEFT JOIN (SELECT p.state AS s, q.state AS t, p.part FROM states p JOIN states q ON p.part = q.part) x ON x.s = a.state AND x.t = b.state GROUP BY ALL")
def u4_state_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = P.states_table(spark, STATES).groupBy("state").agg(F.collect_set("part").alias("parts"))
    a, b = sets.alias("a"), sets.alias("b")
    shared = F.size(F.array_intersect("a.parts", "b.parts")).cast("long")
    return a.join(b, F.col("a.state") < F.col("b.state")).select(F.col("a.state").alias("a"), F.col("b.state").alias("b"), shared.alias("shared"), (~F.arrays_overlap("a.parts", "b.parts")).alias("disjoint"))
