"""Aggregation over neighbours, and the layers built from it.

Sums over a node's neighbours are grouped sums of every component (partial in every task, a row for a node), so that
a node of very many neighbours is never gathered. Matrices of layers multiply in batches of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors as V


def segment_sum(rows: DataFrame, dim: int, by: str = "seg", column: str = "vec") -> DataFrame:
    """``by``, vec: sums of vectors of ``dim`` components by position."""
    return rows.groupBy(by).agg(V.sum_vectors(column, dim).alias("vec"))


def segment_max(rows: DataFrame, dim: int, by: str = "seg", column: str = "vec") -> DataFrame:
    return rows.groupBy(by).agg(V.max_vectors(column, dim).alias("vec"))


def segment_softmax(rows: DataFrame, own: DataFrame, by: str = "seg") -> DataFrame:
    """``rows`` (seg, x) with weight: e^x over the sum of the segment's, the segment's own term (seg, self_x) included.

    Greatest value and sum are aggregates joined back, not windows, so that a hot segment stays spread."""
    top = rows.groupBy(by).agg(F.max("x").alias("_top"))
    tops = own.join(top, by, "left").select(by, "self_x", F.greatest("self_x", F.coalesce("_top", "self_x")).alias("_top"))
    keyed = rows.join(tops, by).withColumn("_e", F.exp(F.col("x") - F.col("_top")))
    sums = keyed.groupBy(by).agg(F.sum("_e").alias("_sum"))
    total = sums.join(tops, by).select(by, (F.col("_sum") + F.exp(F.col("self_x") - F.col("_top"))).alias("_total"))
    return keyed.join(total, by).select(*rows.columns, (F.col("_e") / F.col("_total")).alias("weight"))


def neighbour_sum(edges: DataFrame, emb: DataFrame, to: str = "dst") -> DataFrame:
    """id, vec, degree: sums of the vectors of the other ends of a node's edges (incoming ones for ``to`` dst)."""
    other = "src" if to == "dst" else "dst"
    rows = edges.select(F.col(to).alias("seg"), F.col(other).alias("id")).join(emb.select("id", "emb"), "id")
    return rows.groupBy(F.col("seg").alias("id")).agg(V.sum_vectors("emb", V.dimension(emb)).alias("vec"), F.count(F.lit(1)).alias("degree"))


def sage_gcn(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """id, vec: (sum of neighbours + own) / (degree + 1)."""
    sums = neighbour_sum(edges, emb)
    rows = emb.select("id", "emb").join(sums, "id", "left")
    return rows.select("id", F.when(F.col("vec").isNull(), F.col("emb")).otherwise(F.zip_with("vec", "emb", lambda a, b: (a + b) / (F.col("degree") + 1))).alias("vec"))


def sage_mean(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """id, emb, vec: the mean of neighbours, zero without any."""
    rows = emb.select("id", "emb").join(neighbour_sum(edges, emb), "id", "left")
    return rows.select("id", "emb", F.when(F.col("vec").isNull(), F.transform("emb", lambda _: F.lit(0.0))).otherwise(F.transform("vec", lambda a: a / F.greatest(F.col("degree"), F.lit(1)))).alias("vec"))


def gcn(edges: DataFrame, emb: DataFrame) -> DataFrame:
    """id, vec: neighbours and own vector, each by 1 / sqrt of the product of both ends' degrees (own edge counted)."""
    degrees = emb.select("id").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_d")), "id", "left").select("id", (F.coalesce("_d", F.lit(0)) + 1).alias("_d"))
    scaled = emb.select("id", "emb").join(degrees, "id").select("id", F.transform("emb", lambda x: x / F.sqrt(F.col("_d"))).alias("emb"), "_d")
    sums = segment_sum(edges.select(F.col("dst").alias("seg"), F.col("src").alias("id")).join(scaled, "id").select("seg", F.col("emb").alias("vec")), V.dimension(emb)).withColumnRenamed("seg", "id")
    rows = scaled.join(sums, "id", "left")
    own = F.when(F.col("vec").isNull(), F.col("emb")).otherwise(F.zip_with("vec", "emb", lambda a, b: a + b))
    return rows.select("id", F.transform(own, lambda x: x / F.sqrt(F.col("_d"))).alias("vec"))


def linear(rows: DataFrame, weights: np.ndarray, column: str = "vec", bias: np.ndarray | None = None) -> DataFrame:
    """``rows`` (id, ``column``) times a matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                out = np.stack(frame[column].to_numpy()) @ weights + (0 if bias is None else bias)
                yield pd.DataFrame({"id": frame["id"], "vec": list(out)})

    return rows.select("id", column).mapInPandas(run, "id long, vec array<double>")


def gat(edges: DataFrame, emb: DataFrame, weights: np.ndarray, attend: np.ndarray, slope: float = 0.2) -> DataFrame:
    """id, vec: attention over incoming neighbours and the node itself, heads side by side.

    ``weights``: (heads, d, k); ``attend``: (heads, 2, k), for the neighbour and for the node. Scores need the two
    ends' projections only, so that edges carry two numbers for each head until the weighted sums.
    """
    heads = len(weights)
    out = None
    for h in range(heads):
        projected = linear(emb.select("id", F.col("emb").alias("vec")), weights[h])
        side = lambda v: F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        terms = projected.select("id", "vec", side(attend[h][0]).alias("_from"), side(attend[h][1]).alias("_to"))
        leaky = lambda x: F.when(x > 0, x).otherwise(x * slope)
        ends = edges.select("src", "dst").join(terms.select(F.col("id").alias("src"), "_from"), "src").join(terms.select(F.col("id").alias("dst"), "_to"), "dst")
        own = terms.select(F.col("id").alias("seg"), leaky(F.col("_from") + F.col("_to")).alias("self_x"))
        rows = ends.select(F.col("dst").alias("seg"), "src", leaky(F.col("_from") + F.col("_to")).alias("x"))
        both = rows.unionByName(own.select("seg", F.col("seg").alias("src"), F.col("self_x").alias("x")))
        top = both.groupBy("seg").agg(F.max("x").alias("_top"))
        weighed = both.join(top, "seg").withColumn("_e", F.exp(F.col("x") - F.col("_top")))
        total = weighed.groupBy("seg").agg(F.sum("_e").alias("_total"))
        shares = weighed.join(total, "seg").select("seg", F.col("src").alias("id"), (F.col("_e") / F.col("_total")).alias("_w"))
        summed = segment_sum(shares.join(terms.select("id", "vec"), "id").select("seg", F.transform("vec", lambda x: x * F.col("_w")).alias("vec")), weights[h].shape[1])
        part = summed.select(F.col("seg").alias("id"), F.col("vec").alias(f"_h{h}"))
        out = part if out is None else out.join(part, "id")
    return out.select("id", F.concat(*[f"_h{h}" for h in range(heads)]).alias("vec"))


def rgcn(edges: DataFrame, emb: DataFrame, weights: np.ndarray, own: np.ndarray) -> DataFrame:
    """id, vec: own vector by ``own``, and the mean over outgoing edges of the other end by its relation's matrix.

    Vectors are averaged by (node, relation) before they are multiplied, once for each pair.
    """
    keyed = edges.select("src", "rel", F.col("dst").alias("id")).join(emb.select("id", "emb"), "id")
    sums = keyed.groupBy("src", "rel").agg(V.sum_vectors("emb", weights.shape[1]).alias("vec"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                out = np.einsum("nd,ndk->nk", np.stack(frame["vec"].to_numpy()), weights[frame["rel"].to_numpy()]) / frame["degree"].to_numpy()[:, None]
                yield pd.DataFrame({"seg": frame["src"], "vec": list(out)})

    messages = segment_sum(sums.join(degree, "src").select("src", "rel", "vec", "degree").mapInPandas(run, "seg long, vec array<double>"), weights.shape[2]).withColumnRenamed("seg", "id")
    selves = linear(emb.select("id", F.col("emb").alias("vec")), own).withColumnRenamed("vec", "_own")
    rows = selves.join(messages, "id", "left")
    return rows.select("id", F.when(F.col("vec").isNull(), F.col("_own")).otherwise(F.zip_with("vec", "_own", lambda a, b: a + b)).alias("vec"))


def concat_parts(*parts: Column) -> Column:
    return F.concat(*parts)


def finish(vec: Column, bias: Column, activation) -> Column:
    """Bias once, then the activation."""
    return F.transform(F.zip_with(vec, bias, lambda a, b: a + b), activation)


def encode(edges: DataFrame, emb: DataFrame, stages: list) -> DataFrame:
    """id, emb after stages, each a function of edges and (id, emb) that gives (id, vec)."""
    out = emb.select("id", "emb")
    for stage in stages:
        out = stage(edges, out).select("id", F.col("vec").alias("emb"))
    return out
