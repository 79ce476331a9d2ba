"""Graphs derived from the star schema's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.hashing import uniform
from weftgraph.sources.shared import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (customer), rel (return flag), dst (part): a knowledge graph with string ids."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.concat(F.lit("c:"), "o_custkey").alias("src"), F.col("l_returnflag").alias("rel"), F.concat(F.lit("p:"), "l_partkey").alias("dst")).distinct()


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (part), dst (supplier): untyped edges with long ids."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def n_vectors(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def folded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel, dst of ``folded``, as often as lineitem has them."""
    n = n_vectors(spark, sf_dir)
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % n).alias("src"), code.alias("rel"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("dst"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel, dst: typed edges among the rows of embeddings, by folding the keys of lineitem."""
    return folded_rows(spark, sf_dir).distinct()


def folded_in_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str | Column]]:
    """The edges of ``folded`` as a written table, and what they are ordered by: src, rel, dst.

    An edge is moved and compared as one whole number, which has both remainders (from 0, which stands for null, to
    2n - 1) and the relation as its digits.
    """
    rows, n = folded_rows(spark, sf_dir), n_vectors(spark, sf_dir)
    if n > 1 << 29:  # 12 n^2 is no long
        return cut(rows.distinct()), ["src", "rel", "dst"]
    place = lambda end: F.coalesce(F.col(end) + n, F.lit(0)).cast("long")
    codes = cut(rows.select(((place("src") * 3 + F.col("rel")) * (2 * n) + place("dst")).alias("_code")).distinct())
    digits = {"src": f"_code div {6 * n}L", "rel": f"(_code div {2 * n}L) % 3", "dst": f"_code % {2 * n}L"}
    ends = [F.expr(x) if c == "rel" else F.when(F.expr(x) != 0, F.expr(x) - n) for c, x in digits.items()]
    return codes.select(*[e.cast(rows.schema[c].dataType).alias(c) for c, e in zip(digits, ends, strict=True)], "_code"), ["_code"]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, emb (array<double>) and label of each node of ``folded``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"), "label")


def relation_vectors(spark: SparkSession, n_relations: int = 3, dim: int = 64, seed: str = "rel") -> DataFrame:
    """rel and vec: seeded components in [-1, 1)."""
    place = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: uniform(seed, F.col("rel"), i) * 2 - 1)
    return spark.range(n_relations).select(F.col("id").cast("int").alias("rel"), place.alias("vec"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """at, user_id, event_type, ts of events in time order."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


#: Common table expressions of the graphs in SQL.
HEX = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
PURCHASES = "kg AS (SELECT DISTINCT 'c:' || o_custkey AS src, l_returnflag AS rel, 'p:' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
SUPPLIES = "cooc AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
FOLDED = "nv AS (SELECT count(*) AS n FROM embeddings), vec AS (SELECT DISTINCT l_partkey % n AS src, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rel, (l_orderkey * 7 + l_suppkey) % n AS dst FROM lineitem, nv)"
VECTORS = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS emb, label FROM embeddings)"
RELATIONS = "rels AS (SELECT CAST(r AS INT) AS rel, [CAST('0x' || substr(md5('rel:' || r || ':' || i), 1, 8) AS BIGINT) / 4294967296.0 * 2 - 1 FOR i IN range(64)] AS vec FROM range(3) t(r))"


def sql_hash(*parts: str) -> str:
    """SQL of the seeded whole number of string and column parts."""
    return HEX.format(" || ':' || ".join(parts))


def sql_order(*parts: str) -> str:
    return f"md5({' || chr(58) || '.join(parts)})"
