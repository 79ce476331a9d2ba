"""Queries of scores, losses, initial values, layers and training (M, E)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import losses as L
from weftgraph.functions import vectors as V
from weftgraph.functions.optim import SGD, Adagrad, Adam, average, init
from weftgraph.operators import messages as E
from weftgraph.operators import scoring as S
from weftgraph.operators import train as T
from weftgraph.plans.base import query
from weftgraph.plans.graph import SCORED_CAND, scored_candidates
from weftgraph.plans.ingest import EDGE_IDS, edges_with_ids
from weftgraph.sources.graphs import FOLDED, RELATIONS, VECTORS, folded, n_vectors, relation_vectors, table, vectors
from weftgraph.sources.shared import cut

ENDS = f"{EDGE_IDS}, {VECTORS}, {RELATIONS}, ends AS (SELECT edge_id, ids.rel, a.emb AS s, r.vec AS r, b.emb AS d FROM ids JOIN emb a ON src = a.id JOIN emb b ON dst = b.id JOIN rels r ON r.rel = ids.rel)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edges_with_ids(spark, sf_dir)
    rows = S.with_relation(S.with_ends(edges, vectors(spark, sf_dir)), relation_vectors(spark))
    return rows.select("edge_id", "rel", F.col("src_emb").alias("s"), F.col("rel_vec").alias("r"), F.col("dst_emb").alias("d"))


def _rounded(rows: DataFrame, **columns) -> DataFrame:
    return rows.select("edge_id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


IMAG = "list_concat([s[i] * r[i] - s[i + 32] * r[i + 32] FOR i IN range(1, 33)], [s[i] * r[i + 32] + s[i + 32] * r[i] FOR i IN range(1, 33)])"
HAD = "[s[i] * r[i] FOR i IN range(1, 65)]"
ADD = "[s[i] + r[i] FOR i IN range(1, 65)]"


@query(f"WITH {ENDS} SELECT edge_id, round(list_sum({HAD}), 6) AS hadamard, round(list_sum({IMAG}), 6) AS complex, round(list_sum({ADD}), 6) AS translated, round(list_sum(s), 6) AS unchanged FROM ends")
def m1_relation_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hadamard, complex Hadamard, translation and none (M1-M4), by the sums of their components."""
    s, r = F.col("s"), F.col("r")
    return _rounded(ends(spark, sf_dir), hadamard=V.total(V.hadamard(s, r)), complex=V.total(V.complex_hadamard(s, r)), translated=V.total(V.add(s, r)), unchanged=V.total(s))


@query(f"WITH {ENDS} SELECT edge_id, round(list_dot_product(s, d), 6) AS dot, round(sqrt(list_sum([(s[i] - d[i] + 1e-6) ** 2 FOR i IN range(1, 65)])), 6) AS pair, round(sqrt(greatest(list_sum([(s[i] - d[i]) ** 2 FOR i IN range(1, 65)]), 1e-8)), 6) AS distance, round(list_dot_product(s, d), 6) AS cosine, round(list_dot_product(r, d) / sqrt(list_dot_product(r, r)) / sqrt(list_dot_product(d, d)), 6) AS normal FROM ends")
def m5_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product, distances and cosine (M5-M7), the latter without and with its lengths."""
    s, r, d = F.col("s"), F.col("r"), F.col("d")
    return _rounded(ends(spark, sf_dir), dot=V.dot(s, d), pair=V.pair_distance(s, d), distance=V.distance(s, d), cosine=V.cosine(s, d), normal=V.cosine(r, d, normalize=True))


@query(f"WITH {ENDS} SELECT edge_id, round(list_dot_product({HAD}, d), 6) AS distmult, round(list_dot_product({IMAG}, d), 6) AS complex, round(sqrt(list_sum([(s[i] + r[i] - d[i] + 1e-6) ** 2 FOR i IN range(1, 65)])), 6) AS transe FROM ends")
def m8_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of positives by each decoder (M8-M10); a TransE score is a distance and grows with it."""
    rels, names = relation_vectors(spark), ("distmult", "complex", "transe")
    rows = S.scored(edges_with_ids(spark, sf_dir).select("edge_id", "src", "rel", "dst"), vectors(spark, sf_dir), {k: (k, "src", "dst", rels) for k in names}, positive=True)
    return _rounded(rows, **{k: F.col(k) for k in names})


@query(f"WITH {EDGE_IDS}, {VECTORS}, {RELATIONS} SELECT edge_id, round(list_dot_product([a.emb[i] * r.vec[i] FOR i IN range(1, 65)], b.emb), 6) AS score, round(list_dot_product([b.emb[i] * -r.vec[i] FOR i IN range(1, 65)], a.emb), 6) AS inverse_score FROM ids JOIN emb a ON src = a.id JOIN emb b ON dst = b.id JOIN rels r ON r.rel = ids.rel")
def m11_positive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and inverse scores, the inverse relations being the negated ones."""
    rels = relation_vectors(spark)
    inverse = rels.select("rel", V.scale(F.col("vec"), -1.0).alias("vec"))
    rows = S.score_positives(edges_with_ids(spark, sf_dir), vectors(spark, sf_dir), rels, inverse=inverse)
    return rows.select("edge_id", F.round("score", 6).alias("score"), F.round("inverse_score", 6).alias("inverse_score"))


@query("SELECT event_id, round(greatest(value - 50, 0.0), 6) AS relu, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sigmoid FROM events")
def m15_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") - 50
    return table(spark, sf_dir, "events").select("event_id", F.round(L.relu(x), 6).alias("relu"), F.round(L.sigmoid(x / 10), 6).alias("sigmoid"))


@query(f"""WITH {ENDS}, x AS (SELECT edge_id, list_dot_product(s, d) AS pos, [s[i] * 3 FOR i IN range(1, 11)] AS neg, CAST(edge_id % 2 = 0 AS DOUBLE) AS y FROM ends)
SELECT edge_id, round(ln(exp(pos) + list_sum([exp(v) FOR v IN neg])) - pos, 6) AS softmax, round(list_sum([greatest(v - pos + 0.1, 0) FOR v IN neg]), 6) AS ranking,
 round(ln(list_sum([exp(v) FOR v IN neg])) - neg[3], 6) AS cross_entropy, round(-(y * ln(1 / (1 + exp(-pos))) + (1 - y) * ln(1 - 1 / (1 + exp(-pos)))), 6) AS bce, round(ln(1 + exp(pos)) - y * pos, 6) AS bce_logits,
 round((pos - y) * (pos - y), 6) AS mse, round(ln(1 + exp(CASE WHEN y > 0 THEN -pos ELSE pos END)), 6) AS softplus FROM x""")
def m16_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All losses (M16-M22) by row."""
    rows = ends(spark, sf_dir).select("edge_id", V.dot(F.col("s"), F.col("d")).alias("pos"), F.transform(F.slice("s", 1, 10), lambda x: x * 3).alias("neg"), F.when(F.col("edge_id") % 2 == 0, 1.0).otherwise(0.0).alias("y"))
    pos, neg, y = F.col("pos"), F.col("neg"), F.col("y")
    return _rounded(rows, softmax=L.softmax_loss(pos, neg), ranking=L.ranking_loss(pos, neg), cross_entropy=L.cross_entropy(neg, F.lit(2)), bce=L.bce_after_sigmoid(pos, y), bce_logits=L.bce_with_logits(pos, y), mse=L.squared_error(pos, y), softplus=L.softplus_loss(pos, y))


@query(f"WITH {ENDS}, x AS (SELECT rel, ln(1 + exp(list_dot_product(s, d))) AS l FROM ends) SELECT rel, round(sum(l), 4) AS total, round(avg(l), 6) AS mean FROM x GROUP BY rel")
def m23_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = L.softplus(V.dot(F.col("s"), F.col("d")))
    return ends(spark, sf_dir).select("rel", loss.alias("l")).groupBy("rel").agg(F.round(L.reduced(F.col("l"), "sum"), 4).alias("total"), F.round(L.reduced(F.col("l"), "mean"), 6).alias("mean"))


@query(f"WITH {VECTORS} SELECT id, round(0.001 * list_sum([abs(x) ** 2 FOR x IN emb]), 8) AS l2, round(0.001 * list_sum([abs(x) ** 3 FOR x IN emb]), 8) AS l3 FROM emb")
def m24_norm_regularizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.round(L.norm_regularizer(F.col("emb"), 2), 8).alias("l2"), F.round(L.norm_regularizer(F.col("emb"), 3), 8).alias("l3"))


@query("SELECT n AS id, i, round((CAST('0x' || substr(md5('init:' || n || ':' || i), 1, 8) AS BIGINT) / 4294967296.0 * 2 - 1) * sqrt(6.0 / (100 + 8)), 6) AS x FROM range(100) t(n), range(8) u(i)")
def m25_glorot_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded initial vectors within Glorot's limit."""
    limit = (6 / (100 + 8)) ** 0.5
    return T.initial_vectors(spark, 100, 8, limit).select("id", F.posexplode("emb").alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT * FROM (VALUES ('distmult', 4.0), ('complex', 2.0), ('transe', 0.0)) t(decoder, total)")
def m25_relation_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the initial relation vectors of four components."""
    rows = spark.createDataFrame([("distmult",), ("complex",), ("transe",)], "decoder string")
    total = F.lit(0.0)
    for k in ("distmult", "complex", "transe"):
        total = F.when(F.col("decoder") == k, V.total(S.relation_init(k, 4))).otherwise(total)
    return rows.select("decoder", total.alias("total"))


#: Steps of 50 by recursion on w from 1 with the gradient 2w.
OPTIMIZERS_SQL = """WITH RECURSIVE r AS (SELECT 0 AS t, 1.0::DOUBLE AS sgd, 1.0::DOUBLE AS ada, 0.0::DOUBLE AS s, 1.0::DOUBLE AS adam, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 1.0::DOUBLE AS ams, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS top
UNION ALL SELECT t + 1, sgd - 0.1 * 2 * sgd, ada - 0.5 / (1 + t * 0.01) * 2 * ada / (sqrt(s + 4 * ada * ada) + 1e-10), s + 4 * ada * ada,
 adam - 0.1 / (1 - 0.9 ** (t + 1)) * (0.9 * m + 0.1 * 2 * adam) / (sqrt(0.999 * v + 0.001 * 4 * adam * adam) / sqrt(1 - 0.999 ** (t + 1)) + 1e-8), 0.9 * m + 0.1 * 2 * adam, 0.999 * v + 0.001 * 4 * adam * adam,
 ams - 0.1 / (1 - 0.9 ** (t + 1)) * (0.9 * m2 + 0.1 * 2 * ams) / (sqrt(greatest(top, 0.999 * v2 + 0.001 * 4 * ams * ams)) / sqrt(1 - 0.999 ** (t + 1)) + 1e-8), 0.9 * m2 + 0.1 * 2 * ams, 0.999 * v2 + 0.001 * 4 * ams * ams, greatest(top, 0.999 * v2 + 0.001 * 4 * ams * ams)
 FROM r WHERE t < 50)
SELECT unnest(['sgd', 'adagrad', 'adam', 'amsgrad']) AS optimizer, round(abs(unnest([sgd, ada, adam, ams])), 9) AS gap FROM r WHERE t = 50"""


@query(OPTIMIZERS_SQL)
def m26_optimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the optimum of a quadratic after steps of each optimizer (M26-M28)."""
    out = []
    for name, make in (("sgd", lambda: SGD(0.1)), ("adagrad", lambda: Adagrad(0.5, decay=0.01)), ("adam", lambda: Adam(0.1)), ("amsgrad", lambda: Adam(0.1, amsgrad=True))):
        params, rule = {"w": init("ones", (4,))}, make()
        for _ in range(50):
            rule.step(params, average([{"w": 2 * params["w"]}, {"w": 2 * params["w"]}]))
        out.append((name, round(float(np.abs(params["w"]).max()), 9)))
    return spark.createDataFrame(out, "optimizer string, gap double")


@query(f"""WITH {VECTORS}, g AS (SELECT id, [emb[i] * 0.5 FOR i IN range(1, 65)] AS g FROM emb WHERE label < 5)
SELECT e.id, i, round(e.emb[i] + CASE WHEN g.id IS NULL THEN 0 ELSE -0.1 * g[i] / (sqrt(0.25 + g[i] * g[i]) + 1e-10) END, 6) AS x, round(0.25 + coalesce(g[i] * g[i], 0), 6) AS state FROM emb e LEFT JOIN g ON g.id = e.id, range(1, 65) t(i)""")
def m29_sparse_adagrad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of half the labels have a gradient."""
    rows = vectors(spark, sf_dir).drop("label").withColumn("state", F.array_repeat(F.lit(0.25), 64))
    grads = rows.join(vectors(spark, sf_dir).where("label < 5").select("id"), "id").select("id", V.scale(F.col("emb"), 0.5).alias("grad"))
    out = T.sparse_adagrad(rows, grads).select("id", F.posexplode(F.arrays_zip("emb", "state")).alias("i", "p"))
    return out.select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("p.emb", 6).alias("x"), F.round("p.state", 6).alias("state"))


@query(f"""WITH {SCORED_CAND}, z AS (SELECT batch, row, sum(exp(score)) AS z FROM sc GROUP BY ALL), p AS (SELECT batch, row, score, exp(score) / z AS p FROM sc JOIN z USING (batch, row))
SELECT batch, round(-avg((2 / (1 + exp(-score)) - 1) * p * ln(p)), 9) AS loss FROM p GROUP BY batch""")
def m30_policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator's loss by batch: rewards of its candidates, weighed by its chances of choosing them."""
    rows = scored_candidates(spark, sf_dir).select("batch", "row", "score")
    sums = rows.groupBy("batch", "row").agg(F.sum(F.exp("score")).alias("z"))
    p = F.exp("score") / F.col("z")
    return rows.join(sums, ["batch", "row"]).groupBy("batch").agg(F.round(-F.avg((2 * L.sigmoid(F.col("score")) - 1) * p * F.log(p)), 9).alias("loss"))


@query(f"WITH {VECTORS} SELECT id, i, round(emb[i + 8], 6) AS x FROM emb, range(1, 9) t(i)")
def e1_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", F.posexplode(F.slice("emb", 9, 8)).alias("i", "x"))
    return rows.select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


def _unfold(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.posexplode("vec").alias("i", "x")).select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


NBR = f"{FOLDED}, {VECTORS}, nb AS (SELECT dst AS id, i, sum(emb[i]) AS x, count(*) AS deg FROM vec JOIN emb ON src = id, range(1, 65) t(i) GROUP BY ALL)"


@query(f"WITH {NBR} SELECT emb.id, i, round((emb[i] + coalesce(x, 0)) / (coalesce(deg, 0) + 1), 6) AS x FROM emb CROSS JOIN range(1, 65) t(i) LEFT JOIN nb USING (id, i)")
def e2_sage_gcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.sage_gcn(folded(spark, sf_dir), vectors(spark, sf_dir).drop("label")))


@query(f"WITH {NBR} SELECT emb.id, i, round(coalesce(x / deg, 0), 6) AS x FROM emb CROSS JOIN range(1, 65) t(i) LEFT JOIN nb USING (id, i)")
def e3_sage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.sage_mean(folded(spark, sf_dir), vectors(spark, sf_dir).drop("label")).select("id", "vec"))


@query(f"WITH {FOLDED}, {VECTORS}, dg AS (SELECT vec_id AS id, count(dst) + 1 AS k FROM embeddings LEFT JOIN vec ON dst = vec_id GROUP BY vec_id), nb AS (SELECT vec.dst AS id, i, sum(emb[i] / sqrt(k)) AS x FROM vec JOIN emb ON src = emb.id JOIN dg ON dg.id = src, range(1, 65) t(i) GROUP BY ALL) SELECT emb.id, i, round((emb[i] / sqrt(k) + coalesce(x, 0)) / sqrt(k), 6) AS x FROM emb JOIN dg USING (id) CROSS JOIN range(1, 65) t(i) LEFT JOIN nb USING (id, i)")
def e4_gcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.gcn(folded(spark, sf_dir), vectors(spark, sf_dir).drop("label")))


def listed(values: np.ndarray) -> str:
    """A list in SQL."""
    return "[" + ", ".join(repr(float(x)) for x in values) + "]"


def times(vector: str, weights: np.ndarray) -> str:
    """SQL of a vector times a matrix of weights."""
    return "[" + ", ".join(f"list_dot_product({vector}, {listed(column)})" for column in weights.T) + "]"


UNFOLDED = "SELECT id, i, round(vec[i], 6) AS x FROM {0}, range(1, {1}) t(i)"
GAT = init("glorot_uniform", (2, 64, 3), 1), init("glorot_uniform", (2, 2, 3), 2)
GAT_SQL = f"WITH {FOLDED}, {VECTORS}, " + ", ".join(
    f"""proj{h} AS (SELECT id, {times('emb', GAT[0][h])} AS p FROM emb), term{h} AS (SELECT id, p, list_dot_product(p, {listed(GAT[1][h][0])}) AS f, list_dot_product(p, {listed(GAT[1][h][1])}) AS t FROM proj{h}),
both{h} AS (SELECT dst AS id, src AS other FROM vec UNION ALL SELECT id, id FROM emb), x{h} AS (SELECT b.id, o.p, CASE WHEN o.f + n.t > 0 THEN o.f + n.t ELSE 0.2 * (o.f + n.t) END AS x FROM both{h} b JOIN term{h} o ON o.id = other JOIN term{h} n ON n.id = b.id),
top{h} AS (SELECT id, max(x) AS m FROM x{h} GROUP BY id), head{h} AS (SELECT id, {', '.join(f'sum(exp(x - m) * p[{k}]) / sum(exp(x - m)) AS v{k}' for k in (1, 2, 3))} FROM x{h} JOIN top{h} USING (id) GROUP BY id)"""
    for h in (0, 1)
) + ", vecs AS (SELECT a.id, [a.v1, a.v2, a.v3, b.v1, b.v2, b.v3] AS vec FROM head0 a JOIN head1 b USING (id)) " + UNFOLDED.format("vecs", 7)


@query(GAT_SQL)
def e5_gat(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, attend = GAT
    return _unfold(E.gat(folded(spark, sf_dir), vectors(spark, sf_dir), weights, attend))


RGCN = init("glorot_uniform", (3, 64, 2), 3), init("glorot_uniform", (64, 2), 4)
RGCN_SQL = f"""WITH {FOLDED}, {VECTORS}, msg AS (SELECT src AS id, CASE rel {' '.join(f'WHEN {r} THEN {times("emb", RGCN[0][r])}' for r in range(3))} END AS m FROM vec JOIN emb ON emb.id = dst),
mean AS (SELECT id, avg(m[1]) AS a, avg(m[2]) AS b FROM msg GROUP BY id), own AS (SELECT id, {times('emb', RGCN[1])} AS o FROM emb),
vecs AS (SELECT id, [o[1] + coalesce(a, 0), o[2] + coalesce(b, 0)] AS vec FROM own LEFT JOIN mean USING (id)) """ + UNFOLDED.format("vecs", 3)


@query(RGCN_SQL)
def e6_rgcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(E.rgcn(folded(spark, sf_dir), vectors(spark, sf_dir), *RGCN))


@query(f"WITH {VECTORS} SELECT id, i, round(CASE WHEN i <= 4 THEN emb[i] ELSE emb[i + 4] END, 6) AS x FROM emb, range(1, 9) t(i)")
def e7_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(vectors(spark, sf_dir).select("id", E.concat_parts(F.slice("emb", 1, 4), F.slice("emb", 9, 4)).alias("vec")))


@query(f"WITH {VECTORS} SELECT id, i, round(greatest(emb[i] + 0.05 * i, 0), 6) AS x FROM emb, range(1, 65) t(i)")
def e8_bias_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bias = F.array(*[F.lit(0.05 * i) for i in range(1, 65)])
    return _unfold(vectors(spark, sf_dir).drop("label").select("id", E.finish(F.col("emb"), bias, L.relu).alias("vec")))


STAGED_SQL = f"""WITH {FOLDED}, {VECTORS}, first AS (SELECT emb.id, i, (emb[i] + coalesce(x, 0)) / (coalesce(deg, 0) + 1) AS x FROM emb CROSS JOIN range(1, 65) t(i) LEFT JOIN (SELECT dst AS id, i, sum(emb[i]) AS x, count(*) AS deg FROM vec JOIN emb ON src = id, range(1, 65) t(i) GROUP BY ALL) nb USING (id, i)),
dg AS (SELECT vec_id AS id, count(dst) + 1 AS k FROM embeddings LEFT JOIN vec ON dst = vec_id GROUP BY vec_id), scaled AS (SELECT id, i, x / sqrt(k) AS x FROM first JOIN dg USING (id)),
nb2 AS (SELECT dst AS id, i, sum(x) AS y FROM vec JOIN scaled ON src = id GROUP BY ALL), second AS (SELECT id, i, (x + coalesce(y, 0)) / sqrt(k) AS x FROM scaled JOIN dg USING (id) LEFT JOIN nb2 USING (id, i)),
held AS (SELECT id, list(x ORDER BY i) AS v FROM second GROUP BY id), vecs AS (SELECT id, {times('v', init("glorot_uniform", (64, 2), 5))} AS vec FROM held) """ + UNFOLDED.format("vecs", 3)


@query(STAGED_SQL)
def e9_staged_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aggregations and a linear layer."""
    weights = init("glorot_uniform", (64, 2), 5)
    stages = [E.sage_gcn, E.gcn, lambda _, emb: E.linear(emb.select("id", F.col("emb").alias("vec")), weights)]
    return _unfold(E.encode(folded(spark, sf_dir), vectors(spark, sf_dir), stages).select("id", F.col("emb").alias("vec")))


@query(f"WITH {VECTORS} SELECT id, CAST(list_position(emb, list_max(emb)) - 1 AS INTEGER) AS predicted FROM emb")
def e10_node_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes straight from the encoder's output."""
    return vectors(spark, sf_dir).select("id", S.argmax(F.col("emb")).alias("predicted"))


@query(f"WITH {VECTORS}, vecs AS (SELECT id, {times('emb', init('glorot_uniform', (64, 4), 6))} AS vec FROM emb) " + UNFOLDED.format("vecs", 5))
def s17_encode_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = init("glorot_uniform", (64, 4), 6)
    return _unfold(S.encode_nodes(vectors(spark, sf_dir), lambda x: x @ weights).select("id", F.col("emb").alias("vec")))


def _trained(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Mean loss by epoch of training over the folded graph."""
    settings = T.Settings(**({"dim": 16, "epochs": 2, "batch": 2000, "step_batches": 100, "negatives": 50, "inverse_edges": True} | how))
    state = T.train(edges_with_ids(spark, sf_dir), n_vectors(spark, sf_dir), settings, 3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(state.losses)], "epoch int, loss double")


@query()
def train_link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir)


@query()
def train_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, decoder="complex", loss="softplus", reduction="mean", dense_optimizer="adam", dense_rate=0.01)


@query()
def train_transe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives, held in four partitions of which two are resident."""
    return _trained(spark, sf_dir, decoder="transe", method="dns", selected_ratio=0.5, tournament=True, parts=4, capacity=2, ordering="BETA")


@query()
def train_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives chosen by a second table of vectors that learns from their scores."""
    return _trained(spark, sf_dir, loss="ranking", method="gan", selected_ratio=0.2, degree_fraction=0.5, chunks=4)


STEP_SQL = f"""WITH {EDGE_IDS}, {VECTORS}, {RELATIONS},
ends AS (SELECT a.id AS src, b.id AS dst, ids.rel, edge_id, a.emb AS s, r.vec AS r, b.emb AS d FROM ids JOIN emb a ON src = a.id JOIN emb b ON dst = b.id JOIN rels r ON r.rel = ids.rel),
err AS (SELECT *, 2 * (list_dot_product([s[i] * r[i] FOR i IN range(1, 65)], d) - 1) AS e FROM ends),
grads AS (SELECT src AS id, i, e * r[i] * d[i] AS g FROM err, range(1, 65) t(i) UNION ALL SELECT dst, i, e * s[i] * r[i] FROM err, range(1, 65) t(i)),
total AS (SELECT id, i, sum(g) AS g FROM grads GROUP BY ALL)
SELECT emb.id, i, round(emb[i] - CASE WHEN g IS NULL THEN 0 ELSE 0.1 * g / (sqrt(0.25 + g * g) + 1e-10) END, 5) AS x FROM emb CROSS JOIN range(1, 65) t(i) LEFT JOIN total USING (id, i)"""


@query(STEP_SQL)
def train_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors after one superstep over all edges by squared error without negatives, from given vectors."""
    settings = T.Settings(dim=64, loss="mse", batch=1000, negatives=0)
    vecs = np.array([r["vec"] for r in relation_vectors(spark).orderBy("rel").collect()])
    table = cut(vectors(spark, sf_dir).select("id", "emb", F.transform("emb", lambda x: F.lit(0.25)).alias("state")))
    state, _ = T.step_over(edges_with_ids(spark, sf_dir), settings, T.State(table, {"relations": vecs}, T.optimizer("sgd", 0.1)))
    out = state.table.select("id", F.posexplode("emb").alias("i", "x"))
    return out.select("id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


@query()
def train_node_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a softmax over vectors averaged with their neighbours', and its first and last loss."""
    emb = vectors(spark, sf_dir)
    rows = E.sage_gcn(folded(spark, sf_dir), emb.select("id", "emb")).join(emb.select("id", "emb", "label"), "id").select("id", F.concat("emb", "vec").alias("vec"), "label")
    weights, found = T.train_classifier(rows, 10, epochs=20)
    scored = E.linear(rows, weights[:-1], bias=weights[-1]).join(rows.select("id", "label"), "id").select("label", S.argmax(F.col("vec")).alias("predicted"))
    accuracy = S.accuracy(scored).first().accuracy
    return spark.createDataFrame([(found[0], found[-1], accuracy)], "first_loss double, last_loss double, accuracy double")
