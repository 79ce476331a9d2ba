"""Queries of batches, neighbourhoods, negatives and their selection (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.ranking import positions
from weftgraph.operators import sampling as N
from weftgraph.operators import scoring as S
from weftgraph.plans.base import query
from weftgraph.plans.graph import CAND, DEG, GRID, HOP, N_NEG, ROOTS, batched, candidates, n_batches, roots, scored_candidates
from weftgraph.plans.ingest import EDGE_IDS, edges_with_ids
from weftgraph.sources.graphs import FOLDED, RELATIONS, VECTORS, folded, n_vectors, relation_vectors, sql_hash, vectors


@query(f"WITH {EDGE_IDS}, {GRID} SELECT batch, row, edge_id FROM batched")
def n1_edge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir).select("batch", "row", "edge_id")


@query(f"WITH {EDGE_IDS}, {ROOTS}, f AS (SELECT root, root AS node FROM roots) SELECT root, direction, count(*) AS n, CAST(sum(src + dst) AS BIGINT) AS ends FROM ({HOP.format(0, 'f')}) GROUP BY ALL")
def n2_all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.neighbours(roots(spark, sf_dir).withColumn("node", F.col("root")), edges_with_ids(spark, sf_dir))
    return found.groupBy("root", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") + F.col("dst")).alias("ends"))


UNIFORM = """found AS (SELECT *, row_number() OVER (PARTITION BY root, node, direction ORDER BY edge_id) - 1 AS place, count(*) OVER (PARTITION BY root, node, direction) AS degree FROM ({hop})),
draws AS (SELECT DISTINCT root, node, direction, s AS slot, {hash} % degree AS place FROM found, range(10) t(s) WHERE degree > 10)"""


@query(f"""WITH {EDGE_IDS}, {ROOTS}, f AS (SELECT root, root AS node FROM roots), {UNIFORM.format(hop=HOP.format(0, 'f'), hash=sql_hash(chr(39) + 'uniform' + chr(39), 'root', 'node', 'direction', 's'))}
SELECT root, direction, edge_id, CAST(place AS INTEGER) AS slot FROM found WHERE degree <= 10 UNION ALL SELECT d.root, d.direction, edge_id, CAST(d.slot AS INTEGER) FROM draws d JOIN found USING (root, node, direction, place)""")
def n3_uniform_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten draws with replacement where there are more than ten edges."""
    frontier = roots(spark, sf_dir).withColumn("node", F.col("root"))
    return N.sample_uniform(frontier, N.adjacency(edges_with_ids(spark, sf_dir)), 10).select("root", "direction", "edge_id", "slot")


@query(f"WITH {EDGE_IDS}, {ROOTS}, f AS (SELECT root, root AS node FROM roots) SELECT root, direction, edge_id FROM ({HOP.format(0, 'f')}) WHERE {sql_hash(chr(39) + 'dropout' + chr(39), 'root', 'edge_id', 'direction')} / 4294967296.0 >= 0.7")
def n4_dropout_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.neighbours(roots(spark, sf_dir).withColumn("node", F.col("root")), edges_with_ids(spark, sf_dir))
    return N.sample_dropout(found, 0.7).select("root", "direction", "edge_id")


def hop_sql(hop: int, most: int = 5) -> str:
    """Tables of one hop: the edges out of its frontier f<hop>, what is drawn of them, and the next frontier."""
    seen = " UNION ".join(f"SELECT root, node FROM f{h}" for h in range(hop + 1))
    place = sql_hash(f"'hop{hop}'", "root", "node", "'out'", "s")
    return f"""found{hop} AS (SELECT root, node, edge_id, src, rel, dst, row_number() OVER (PARTITION BY root, node ORDER BY edge_id) - 1 AS place, count(*) OVER (PARTITION BY root, node) AS degree FROM f{hop} JOIN ids ON src = node),
draws{hop} AS (SELECT root, node, s, {place} % degree AS place FROM (SELECT DISTINCT root, node, degree FROM found{hop}), range({most}) t(s) WHERE degree > {most}),
h{hop} AS (SELECT {hop} AS hop, root, edge_id, src, rel, dst FROM found{hop} WHERE degree <= {most} UNION ALL SELECT {hop}, root, edge_id, src, rel, dst FROM draws{hop} JOIN found{hop} USING (root, node, place)),
f{hop + 1} AS (SELECT root, dst AS node FROM h{hop} EXCEPT ({seen}))"""


HOPS = f"{EDGE_IDS}, {ROOTS}, f0 AS (SELECT root, root AS node FROM roots), {hop_sql(0)}, {hop_sql(1)}"


def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five outgoing edges of every node, and of what they reach."""
    return N.k_hop(roots(spark, sf_dir), edges_with_ids(spark, sf_dir), 2, incoming=False, most=5)


@query(f"WITH {HOPS} SELECT root, hop, count(*) AS n, count(DISTINCT dst) AS reached, CAST(sum(edge_id) AS BIGINT) AS ids FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1) GROUP BY ALL")
def n5_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_hops(spark, sf_dir).groupBy("root", "hop").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("reached"), F.sum("edge_id").alias("ids"))


@query(f"WITH {EDGE_IDS}, {ROOTS}, s AS (SELECT root, edge_id, src, dst FROM roots JOIN ids ON src = root), ends AS (SELECT root, edge_id, true AS is_src, src AS node FROM s UNION ALL SELECT root, edge_id, false, dst FROM s), loc AS (SELECT *, dense_rank() OVER (PARTITION BY root ORDER BY node) - 1 AS local FROM ends) SELECT root, edge_id, max(CASE WHEN is_src THEN local END) AS local_src, max(CASE WHEN NOT is_src THEN local END) AS local_dst FROM loc GROUP BY root, edge_id")
def n6_local_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.neighbours(roots(spark, sf_dir).withColumn("node", F.col("root")), edges_with_ids(spark, sf_dir), incoming=False)
    return N.local_subgraph(found)[1].select("root", "edge_id", "local_src", "local_dst")


@query(f"WITH {HOPS} SELECT root, edge_id, src, rel, dst FROM h0")
def n7_drop_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers that are left when the outer one is done."""
    return two_hops(spark, sf_dir).where("hop < 1").select("root", "edge_id", "src", "rel", "dst")


NEGATIVES = "WITH " + FOLDED + " SELECT b AS batch, CAST(c AS INTEGER) AS chunk, CAST(s AS INTEGER) AS slot, {hash} % (SELECT n FROM nv) AS node FROM range((SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM vec)) x(b), range({c}) y(c), range({n}) z(s)"


@query(NEGATIVES.format(hash=sql_hash("'neg'", "b", "c", "s"), c=10, n=100))
def n8_uniform_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.uniform_negatives(spark, n_batches(spark, sf_dir), 10, 100, n_vectors(spark, sf_dir))


@query(f"WITH {EDGE_IDS}, {GRID}, {DEG} SELECT deg.batch, deg.chunk, slot, sample_row, dst AS node FROM deg JOIN batched ON deg.batch = batched.batch AND sample_row = row")
def n9_degree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.degree_negatives(batched(spark, sf_dir), n_batches(spark, sf_dir), 4, 20)


MIXED = f"""{EDGE_IDS}, {GRID}, sizes AS (SELECT batch, count(*) AS size FROM batched GROUP BY batch),
deg AS (SELECT x.b AS batch, CAST(y.c AS INTEGER) AS chunk, CAST(z.s AS INTEGER) AS slot, CAST({sql_hash("'neg-deg'", 'x.b', 'y.c', 'z.s')} % size AS INTEGER) AS sample_row FROM sizes JOIN (SELECT batch AS b FROM sizes) x ON batch = x.b, range(4) y(c), range(7) z(s)),
uni AS (SELECT x.b AS batch, CAST(y.c AS INTEGER) AS chunk, CAST(z.s + 7 AS INTEGER) AS slot, {sql_hash("'neg'", 'x.b', 'y.c', 'z.s')} % (SELECT n FROM nv) AS node FROM (SELECT batch AS b FROM sizes) x, range(4) y(c), range(13) z(s))"""


@query(f"WITH {MIXED} SELECT deg.batch, deg.chunk, slot, dst AS node FROM deg JOIN batched ON deg.batch = batched.batch AND sample_row = row UNION ALL SELECT batch, chunk, slot, node FROM uni")
def n10_mixed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty of which int(20 * 0.35) follow degrees."""
    return N.negatives(batched(spark, sf_dir), n_batches(spark, sf_dir), 4, 20, n_vectors(spark, sf_dir), 0.35).select("batch", "chunk", "slot", "node")


@query(f"WITH {MIXED} SELECT b.batch, b.chunk, slot, src AS src_node, dst AS dst_node FROM deg b JOIN batched ON b.batch = batched.batch AND sample_row = row UNION ALL SELECT batch, chunk, slot, node, node FROM uni")
def n11_shared_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends' negatives from the same draws."""
    n = n_vectors(spark, sf_dir)
    side = lambda end: N.negatives(batched(spark, sf_dir), n_batches(spark, sf_dir), 4, 20, n, 0.35, end).select("batch", "chunk", "slot", F.col("node").alias(f"{end}_node"))
    return side("src").join(side("dst"), ["batch", "chunk", "slot"])


@query(f"WITH {EDGE_IDS}, q AS (SELECT DISTINCT src, rel FROM vec), open AS (SELECT src, rel, c.vec_id AS node FROM q, embeddings c EXCEPT SELECT src, rel, dst FROM vec), sums AS (SELECT src, rel, count(*) AS n, CAST(sum(node) AS BIGINT) AS ids FROM open GROUP BY ALL) SELECT edge_id, coalesce(sums.n, 0) AS n, coalesce(sums.ids, 0) AS ids FROM ids LEFT JOIN sums USING (src, rel)")
def n12_filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes but those of known edges, counted: totals less what is listed, so that no pairs are made."""
    nodes = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("_n"), F.sum("id").alias("_ids"))
    asked = edges_with_ids(spark, sf_dir).select("edge_id", "src", "rel")
    known = folded(spark, sf_dir).groupBy("src", "rel").agg(F.count(F.lit(1)).alias("k"), F.sum("dst").alias("dsts"))
    return asked.join(known, ["src", "rel"]).join(F.broadcast(nodes)).select("edge_id", (F.col("_n") - F.col("k")).alias("n"), (F.col("_ids") - F.col("dsts")).alias("ids"))  # one row


@query(f"WITH {CAND}, {VECTORS}, sc AS (SELECT batch, row, slot, src, rel, node, round(list_dot_product(a.emb, b.emb), 6) AS score FROM cand JOIN emb a ON src = a.id JOIN emb b ON node = b.id) SELECT batch, row, slot, CASE WHEN EXISTS (SELECT 1 FROM vec k WHERE k.src = sc.src AND k.rel = sc.rel AND k.dst = sc.node) THEN -1e9 ELSE score END AS score FROM sc")
def n13_mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = N.flag_known(candidates(spark, sf_dir), folded(spark, sf_dir)).select("batch", "row", "slot", "filtered")
    rows = scored_candidates(spark, sf_dir).join(flagged, ["batch", "row", "slot"])
    return rows.select("batch", "row", "slot", N.mask_scores(F.col("score"), F.col("filtered")).alias("score"))


@query(f"WITH {CAND} SELECT batch, row, count(*) AS n, count(DISTINCT node) AS n_nodes FROM cand GROUP BY ALL")
def n14_all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("batch", "row").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("n_nodes"))


REL_SCORED = f"{CAND}, {VECTORS}, {RELATIONS}, sc AS (SELECT batch, row, slot, node, round(list_dot_product([a.emb[i] * r.vec[i] FOR i IN range(1, 65)], b.emb), 6) AS score FROM cand JOIN rels r USING (rel) JOIN emb a ON src = a.id JOIN emb b ON node = b.id)"


def model_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.score_candidates(candidates(spark, sf_dir), vectors(spark, sf_dir), relation_vectors(spark))
    return rows.select("batch", "row", "slot", "node", F.round("score", 6).alias("score"))


@query(f"WITH {REL_SCORED} SELECT batch, row, slot, node, score FROM sc QUALIFY row_number() OVER (PARTITION BY batch, row, slot // 2 ORDER BY score DESC, slot) = 1")
def n15_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of ten, each the better of a pair."""
    return S.select_hard(model_scored(spark, sf_dir), N_NEG, 0.5, ["batch", "row"])


@query(f"WITH {CAND}, {VECTORS}, sc AS (SELECT batch, row, slot, node, round(list_dot_product(list_reverse(a.emb), b.emb), 6) AS score FROM cand JOIN emb a ON src = a.id JOIN emb b ON node = b.id) SELECT batch, row, slot, node FROM sc QUALIFY row_number() OVER (PARTITION BY batch, row ORDER BY score DESC, slot) <= 3")
def n16_generator_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected by a second table of vectors (here the first one's, reversed on the source side); three of ten."""
    emb, edges = vectors(spark, sf_dir), edges_with_ids(spark, sf_dir)
    drawn = N.uniform_negatives(spark, -(-edges.count() // 1000), 4, N_NEG, emb.count())
    return S.select_generated(N.batches(N.shuffle_edges(edges), 1000), drawn, 250, emb.select("id", F.reverse("emb").alias("emb")), emb, N_NEG, 0.3)


@query("SELECT CAST(batch // 8 AS INTEGER) AS plan, batch, chunk, slot, node FROM (" + NEGATIVES.format(hash=sql_hash("'neg'", "b", "c", "s"), c=2, n=30) + ")")
def n17_plan_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws made ahead for eight batches at a time."""
    return N.planned_negatives(spark, n_batches(spark, sf_dir), 2, 30, n_vectors(spark, sf_dir), 8)


@query(NEGATIVES.format(hash=sql_hash("'neg'", "(b // 2)", "c", "s"), c=2, n=30))
def n18_reused_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draw serves two batches."""
    return N.uniform_negatives(spark, n_batches(spark, sf_dir), 2, 30, n_vectors(spark, sf_dir), reuse=2)


@query(f"WITH {FOLDED}, r AS (SELECT vec_id AS node, row_number() OVER (ORDER BY vec_id) - 1 AS local FROM embeddings WHERE label < 5) SELECT a AS at, node FROM range((SELECT count(*) FROM vec)) t(a) JOIN r ON local = {sql_hash(chr(39) + 'resident' + chr(39), 'a')} % (SELECT count(*) FROM r)")
def n20_random_residents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pick for each edge among the nodes of half the labels."""
    resident = positions(vectors(spark, sf_dir).where("label < 5").select(F.col("id").alias("node")), ["node"], "local")
    return N.random_nodes(spark, folded(spark, sf_dir).count(), resident)


CORRUPTED = f"{EDGE_IDS}, {GRID}, corrupt AS (SELECT batch, row, edge_id, src, dst, s AS slot, CAST((rel + 1 + {sql_hash(chr(39) + 'rel' + chr(39), 'batch', 'row', 's')} % 2) % 3 AS INTEGER) AS corrupted FROM batched, range(2) t(s))"


@query(f"WITH {CORRUPTED} SELECT batch, row, CAST(slot AS INTEGER) AS slot, corrupted FROM corrupt")
def n19_relation_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.relation_negatives(batched(spark, sf_dir), 2, 3).select("batch", "row", "slot", "corrupted")


@query(f"WITH {CORRUPTED}, {VECTORS}, {RELATIONS} SELECT edge_id, CAST(slot AS INTEGER) AS slot, round(list_dot_product([a.emb[i] * r.vec[i] FOR i IN range(1, 65)], b.emb), 6) AS score FROM corrupt JOIN emb a ON src = a.id JOIN emb b ON dst = b.id JOIN rels r ON r.rel = corrupted")
def m14_relation_corruption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.relation_negatives(batched(spark, sf_dir), 2, 3).select("edge_id", "src", "dst", "slot", F.col("corrupted").alias("rel"))
    scored = S.score_positives(rows, vectors(spark, sf_dir), relation_vectors(spark))
    return scored.select("edge_id", "slot", F.round("score", 6).alias("score"))
