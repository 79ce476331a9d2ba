"""Batches, neighbourhoods and negatives, all chosen by seeded hashes so that a run can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.hashing import digest, pick, uniform
from weftgraph.functions.ranking import places_within, shuffled_positions
from weftgraph.sources.shared import cut, discard_on_exit, new_path


def shuffle_edges(edges: DataFrame, seed: str = "shuffle") -> DataFrame:
    """``edges`` (edge_id, ...) with pos, their place in seeded order."""
    return shuffled_positions(edges, ["edge_id"], seed, "pos")


def batches(positioned: DataFrame, size: int) -> DataFrame:
    """``positioned`` (pos, ...) with batch and row, its place in the batch; the last batch may be short."""
    return positioned.withColumn("batch", F.floor(F.col("pos") / size).cast("long")).withColumn("row", F.pmod("pos", F.lit(size)).cast("int"))


def chunk_size(batch: int, chunks: int) -> int:
    return -(-batch // chunks)


def neighbours(frontier: DataFrame, edges: DataFrame, incoming: bool = True, outgoing: bool = True) -> DataFrame:
    """root, src, rel, dst, direction of all edges at the nodes of ``frontier`` (root, node), one row for each
    direction that reaches a node."""
    out = []
    for wanted, at, direction in ((incoming, "dst", "in"), (outgoing, "src", "out")):
        if wanted:
            keyed = edges.select(F.col(at).alias("node"), "edge_id", "src", "rel", "dst")
            out.append(frontier.join(keyed, "node").select("root", "node", "edge_id", "src", "rel", "dst", F.lit(direction).alias("direction")))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def adjacency(edges: DataFrame, incoming: bool = True, outgoing: bool = True) -> DataFrame:
    """The written table node, direction, _at, edge_id, src, rel, dst: every edge at each of its ends, with its place (from
    0, by edge_id) among those of the node. Places are counted by ranges of ids, so that no task holds all edges of a
    node that has very many."""
    out = []
    for wanted, at, direction in ((incoming, "dst", "in"), (outgoing, "src", "out")):
        if wanted:
            out.append(edges.select(F.col(at).alias("node"), F.lit(direction).alias("direction"), "edge_id", "src", "rel", "dst"))
    return cut(places_within(out[0] if len(out) == 1 else out[0].unionByName(out[1]), ["node", "direction"], "edge_id", "_at"))


def sample_uniform(frontier: DataFrame, listed: DataFrame, most: int, seed: str = "uniform") -> DataFrame:
    """Rows of ``neighbours`` of ``frontier`` (root, node) with slot: all of a node's edges in a direction if there are at
    most ``most``, else that many draws with replacement from its edges in order of edge_id. ``listed``: ``adjacency``.

    Places are drawn from the degrees, and only drawn edges are looked up: a root costs ``most`` rows, whatever the
    degrees of what it reaches.
    """
    degrees = listed.groupBy("node", "direction").agg(F.count(F.lit(1)).alias("_degree"))
    met = frontier.select("root", "node").distinct().join(degrees, "node")
    slots = F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_degree")).cast("int") - 1))
    draws = met.withColumn("slot", slots)
    drawn = pick(F.col("_degree"), seed, F.col("root"), F.col("node"), F.col("direction"), F.col("slot"))
    draws = draws.withColumn("_at", F.when(F.col("_degree") <= most, F.col("slot").cast("long")).otherwise(drawn))
    found = draws.join(listed, ["node", "direction", "_at"])
    return found.select("root", "node", "edge_id", "src", "rel", "dst", "direction", "slot")


def sample_dropout(found: DataFrame, rate: float, seed: str = "dropout") -> DataFrame:
    """Rows of ``neighbours`` that a draw for each of them keeps, with chance 1 - ``rate``."""
    return found.where(uniform(seed, F.col("root"), F.col("edge_id"), F.col("direction")) >= rate)


def k_hop(roots: DataFrame, edges: DataFrame, hops: int, incoming: bool = True, outgoing: bool = True, most: int | None = None, seed: str = "hop") -> DataFrame:
    """root, hop, node, edge_id, src, rel, dst, direction of layered neighbourhoods: each hop starts at the nodes that
    the hop before reached for the first time. ``roots``: root."""
    visited = roots.select("root", F.col("root").alias("node")).distinct()
    frontier, layers = visited, []
    listed = adjacency(edges, incoming, outgoing) if most is not None else None
    for hop in range(hops):
        if most is None:
            found = neighbours(frontier, edges, incoming, outgoing)
        else:
            found = sample_uniform(frontier, listed, most, f"{seed}{hop}").drop("slot")
        if hop + 1 < hops:
            found = cut(found)
            reached = found.select("root", F.when(F.col("direction") == "in", F.col("src")).otherwise(F.col("dst")).alias("node")).distinct()
            frontier = cut(reached.join(visited, ["root", "node"], "left_anti"))
            visited = visited.unionByName(frontier)
        layers.append(found.withColumn("hop", F.lit(hop)))
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def local_subgraph(sampled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionary (root, node, local: place in node order) of each root's sampled edges, and the edges in local ids."""
    nodes = sampled.select("root", F.explode(F.array("src", "dst")).alias("node")).distinct()
    local = nodes.withColumn("local", (F.row_number().over(Window.partitionBy("root").orderBy("node")) - 1).cast("long"))
    out = sampled
    for end in ("src", "dst"):
        out = out.join(local.select("root", F.col("node").alias(end), F.col("local").alias(f"local_{end}")), ["root", end])
    return local, out


def grid(spark: SparkSession, n_batches: int, chunks: int, n: int) -> DataFrame:
    """batch, chunk, slot of every negative; made in as many tasks as the session has partitions."""
    every = spark.range(n_batches * chunks * n)
    return every.select(F.floor(F.col("id") / (chunks * n)).cast("long").alias("batch"), F.pmod(F.floor(F.col("id") / n), F.lit(chunks)).cast("int").alias("chunk"), F.pmod("id", F.lit(n)).cast("int").alias("slot"))


def uniform_negatives(spark: SparkSession, n_batches: int, chunks: int, n: int, n_nodes: int, seed: str = "neg", reuse: int = 1) -> DataFrame:
    """batch, chunk, slot, node: seeded nodes; ``reuse`` batches in a row draw the same ones."""
    drawn = F.floor(F.col("batch") / reuse).cast("long") if reuse > 1 else F.col("batch")
    return grid(spark, n_batches, chunks, n).withColumn("node", pick(n_nodes, seed, drawn, F.col("chunk"), F.col("slot")))


def planned_negatives(spark: SparkSession, n_batches: int, chunks: int, n: int, n_nodes: int, ahead: int, seed: str = "neg") -> DataFrame:
    """The written table plan, batch, chunk, slot, node: draws made ahead for ``ahead`` batches at a time, a folder for
    each plan, so that the batches of a plan read theirs alone."""
    drawn = uniform_negatives(spark, n_batches, chunks, n, n_nodes, seed).withColumn("plan", F.floor(F.col("batch") / ahead).cast("int"))
    path = new_path(spark)
    drawn.write.partitionBy("plan").parquet(path)
    discard_on_exit(spark, path)
    return spark.read.parquet(path).select("plan", "batch", "chunk", "slot", "node")


def degree_negatives(batched: DataFrame, n_batches: int, chunks: int, n: int, end: str = "dst", seed: str = "deg") -> DataFrame:
    """batch, chunk, slot, sample_row, node: ends of random edges of the batch, so that nodes come as often as they
    have edges. ``batched``: batch, row, src, dst."""
    sizes = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("_size"))
    drawn = grid(batched.sparkSession, n_batches, chunks, n).join(sizes, "batch")
    drawn = drawn.withColumn("sample_row", pick(F.col("_size"), seed, F.col("batch"), F.col("chunk"), F.col("slot")).cast("int"))
    ends = batched.select("batch", F.col("row").alias("sample_row"), F.col(end).alias("node"))
    return drawn.join(ends, ["batch", "sample_row"]).select("batch", "chunk", "slot", "sample_row", "node")


def negatives(batched: DataFrame, n_batches: int, chunks: int, n: int, n_nodes: int, degree_fraction: float = 0.0, end: str = "dst", seed: str = "neg") -> DataFrame:
    """batch, chunk, slot, node, sample_row: degree-weighted ones first (int(n * fraction)), uniform ones after."""
    weighted = int(n * degree_fraction)
    rest = uniform_negatives(batched.sparkSession, n_batches, chunks, n - weighted, n_nodes, seed)
    rest = rest.select("batch", "chunk", (F.col("slot") + weighted).alias("slot"), "node", F.lit(None).cast("int").alias("sample_row"))
    if not weighted:
        return rest
    return degree_negatives(batched, n_batches, chunks, weighted, end, f"{seed}-deg").select("batch", "chunk", "slot", "node", "sample_row").unionByName(rest)


def relation_negatives(batched: DataFrame, n: int, n_relations: int, seed: str = "rel") -> DataFrame:
    """``batched`` (batch, row, rel, ...) with slot and corrupted: n seeded relations other than the row's own."""
    shift = 1 + pick(n_relations - 1, seed, F.col("batch"), F.col("row"), F.col("slot"))
    rows = batched.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("corrupted", F.pmod(F.col("rel") + shift, F.lit(n_relations)).cast("int"))


def candidates(batched: DataFrame, drawn: DataFrame, chunk: int) -> DataFrame:
    """Every row of a batch beside the negatives of its chunk (``chunk`` rows each)."""
    keyed = batched.withColumn("chunk", F.floor(F.col("row") / chunk).cast("int"))
    return keyed.join(drawn, ["batch", "chunk"])


def from_own_chunk(sample_row: Column, chunk: Column, size: int) -> Column:
    """Whether a degree-weighted negative was drawn from the chunk that it is scored against."""
    return F.coalesce(F.floor(sample_row / size) == chunk, F.lit(False))


def drop_known(scored: DataFrame, known: DataFrame, by: Sequence[str] = ("src", "rel")) -> DataFrame:
    """Candidates (``by``, node) that are no edge of ``known`` (``by``, dst)."""
    facts = known.select(*by, F.col("dst").alias("node")).distinct()
    return scored.join(facts, [*by, "node"], "left_anti")


def flag_known(scored: DataFrame, known: DataFrame, by: Sequence[str] = ("src", "rel")) -> DataFrame:
    """Candidates with filtered: whether they are an edge of ``known``."""
    facts = known.select(*by, F.col("dst").alias("node")).distinct().withColumn("_known", F.lit(True))
    return scored.join(facts, [*by, "node"], "left").withColumn("filtered", F.coalesce("_known", F.lit(False))).drop("_known")


def drop_local(scored: DataFrame, batched: DataFrame) -> DataFrame:
    """Candidates that are no edge of their own batch."""
    facts = batched.select("batch", "src", "rel", F.col("dst").alias("node")).distinct()
    return scored.join(facts, ["batch", "src", "rel", "node"], "left_anti")


def mask_scores(score: Column, filtered: Column) -> Column:
    return F.when(filtered, F.lit(-1e9)).otherwise(score)


def select_top(scored: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The k rows of highest score for each ``by``, lowest slot first among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "slot")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def select_tournament(scored: DataFrame, n: int, k: int, by: Sequence[str]) -> DataFrame:
    """The best row of each of k equal runs of the n slots (lowest slot among equals); without equal runs the top k.

    The best of a run is an aggregate, so that each task sends on one row for a run and no score matrix is sorted.
    """
    if n % k:
        return select_top(scored, k, by).drop("nth")
    held = [c for c in scored.columns if c not in by]
    best = F.max(F.struct("score", (-F.col("slot")).alias("_low"), *[c for c in held if c not in ("score", "slot")])).alias("x")
    runs = scored.groupBy(*by, F.floor(F.col("slot") / (n // k)).cast("int").alias("run")).agg(best)
    return runs.select(*by, *[(-F.col("x._low")).alias("slot") if c == "slot" else F.col(f"x.{c}").alias(c) for c in held])


def random_nodes(spark: SparkSession, n: int, resident: DataFrame, seed: str = "resident") -> DataFrame:
    """at, node: n seeded picks among the nodes of ``resident`` (local, node)."""
    size = resident.count()
    return spark.range(n).select(F.col("id").alias("at"), pick(size, seed, F.col("id")).alias("local")).join(resident, "local").select("at", "node")


def seeded_order(seed: str, *ids: str) -> Column:
    return digest(seed, *[F.col(i) for i in ids])
