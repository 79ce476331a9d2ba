"""Dictionaries of nodes and relations, and what maps edges and tables through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.hashing import digest
from weftgraph.functions.ranking import positions, shuffled_from, shuffled_positions


def node_universe(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """raw: distinct ends of ``edges`` (src, dst), with the ids of ``known`` (raw) that no edge has."""
    raw = edges.select(F.col("src").alias("raw")).union(edges.select("dst"))
    return (raw.union(known.select("raw")) if known is not None else raw).distinct()


def relation_universe(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("rel").alias("raw")).distinct()


def dense_ids(universe: DataFrame, seed: str = "nodes") -> DataFrame:
    """raw, id: a seeded permutation of 0..n-1."""
    return shuffled_positions(universe.select("raw"), ["raw"], seed, "id")


def sorted_ids(universe: DataFrame) -> DataFrame:
    """raw, id in the order of raw."""
    return positions(universe.select("raw"), ["raw"], "id")


def train_first_ids(universe: DataFrame, train: DataFrame, seed: str = "nodes") -> DataFrame:
    """raw, id: ids of nodes of ``train`` (src, dst) come before all others, each part in seeded order."""
    seen = node_universe(train).withColumn("_seen", F.lit(1))
    flagged = universe.select("raw").join(seen, "raw", "left").withColumn("_late", F.col("_seen").isNull())
    return positions(flagged.select("raw", "_late", digest(seed, F.col("raw")).alias("_hash")), ["_late", "_hash", "raw"], "id").select("raw", "id")


def degree_first_ids(edges: DataFrame, k: int, seed: str = "nodes", train: DataFrame | None = None) -> DataFrame:
    """raw, id: the k nodes of the highest degree first, in that order; then nodes of ``train`` if given; then the
    others, in seeded order."""
    degree = node_degrees(edges).select(F.col("node").alias("raw"), F.col("degree"))
    top = degree.orderBy(F.desc("degree"), "raw").limit(k).withColumn("_top", F.lit(1))
    placed = degree.join(F.broadcast(top.select("raw", "_top")), "raw", "left")  # k rows
    late: Column = F.lit(False)
    if train is not None:
        placed = placed.join(node_universe(train).withColumn("_seen", F.lit(1)), "raw", "left")
        late = F.col("_top").isNull() & F.col("_seen").isNull()
    keyed = placed.select("raw", F.col("_top").isNull().alias("_rest"), F.when(F.col("_top") == 1, -F.col("degree")).otherwise(0).alias("_rank"), late.alias("_late"), F.when(F.col("_top").isNull(), digest(seed, F.col("raw"))).alias("_hash"))
    return positions(keyed, ["_rest", "_rank", "_late", "_hash", "raw"], "id").select("raw", "id")


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree, degree of all ends of ``edges``, in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    summed = ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return summed.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def apply_mapping(edges: DataFrame, nodes: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``edges`` with ids of the dictionaries (raw, id) in place of raw src, dst and rel; other columns stay."""
    ids = lambda name: nodes.select(F.col("raw").alias(name), F.col("id").alias(f"_{name}"))
    out = edges.join(ids("src"), "src").join(ids("dst"), "dst")
    if relations is not None:
        out = out.join(relations.select(F.col("raw").alias("rel"), F.col("id").alias("_rel")), "rel")
    mapped = {"src", "dst"} | ({"rel"} if relations is not None else set())
    return out.select(*[F.col(f"_{c}").alias(c) if c in mapped else F.col(c) for c in edges.columns])


def remap_ids(rows: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """``rows`` with the dictionary's id in place of ``column``."""
    ids = nodes.select(F.col("raw").alias(column), F.col("id").alias("_id"))
    return rows.join(ids, column).select(*[F.col("_id").alias(c) if c == column else F.col(c) for c in rows.columns])


def pad_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label of every node of the dictionary; -1 where ``labels`` (id, label) has none or NaN."""
    return nodes.select("id").join(labels, "id", "left").select("id", no_label(F.col("label").cast("double")).alias("label"))


def no_label(label: Column) -> Column:
    return F.coalesce(F.when(F.isnan(label), None).otherwise(label), F.lit(-1.0)).cast("int")


def split_edges(edges: DataFrame, fractions: tuple[float, ...], ids: list[str], seed: str = "split") -> DataFrame:
    """``edges`` with split (train, valid, test, or train, test): exact sizes, the fractions of the count rounded down;
    the rest belongs to the last split."""
    names = {2: ["train", "test"], 3: ["train", "valid", "test"]}[len(fractions)]
    n = edges.count()
    placed = shuffled_positions(edges, ids, seed, "_at")
    column, total = F.lit(names[-1]), sum(int(n * f) for f in fractions[:-1])
    for name, fraction in list(zip(names, fractions, strict=True))[-2::-1]:
        column = F.when(F.col("_at") < total, name).otherwise(column)
        total -= int(n * fraction)
    return placed.withColumn("split", column).drop("_at")


def last_split(edges: DataFrame, fractions: tuple[float, ...], ids: list[str], seed: str = "split") -> DataFrame:
    """The rows that ``split_edges`` gives to its last split."""
    n = edges.count()
    return shuffled_from(edges, ids, seed, sum(int(n * f) for f in fractions[:-1]))
