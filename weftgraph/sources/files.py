"""Edge files, array sources, sinks and checkpoints."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.ranking import positions
from weftgraph.functions.vectors import dimension, sum_vectors

#: Formats by name. Only the last two are taken from memory.
DELIMITED, ARRAYS = ("CSV", "TSV", "TXT", "DELIM", "DELIMITED"), ("NUMPY", "PYTORCH")


def scan_delimited(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[int] = (0, 1, 2), sep: str = "\t", header: int = 0) -> DataFrame:
    """src, rel, dst (or src, dst for two ``columns``) as text, from the file's columns at those places.

    ``header``: lines to skip at the start of each file.
    """
    width = max(columns) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    reader = spark.read.schema(schema).option("sep", sep)
    if header == 1:
        reader = reader.option("header", True).option("enforceSchema", True)
    if header <= 1:
        rows = reader.csv(paths)
    else:
        lines = strip_header(spark, paths, header)
        rows = lines.select(F.split("line", F.lit("\\Q" + sep + "\\E")).alias("v")).select(*[F.get("v", F.lit(i)).alias(f"c{i}") for i in range(width)])
    names = ["src", "dst"] if len(columns) == 2 else ["src", "rel", "dst"]
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in zip(columns, names, strict=True)])


def strip_header(spark: SparkSession, paths: Sequence[str] | str, n: int) -> DataFrame:
    """line of each file without its first ``n`` lines.

    The reader splits a file into ranges; a line's place in its file follows from the lines of the ranges before.
    """
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    first = lines.where("_start = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    return lines.join(first, "_file").where(F.col("_at") >= F.col("_first") + n).select("line")


def scan_arrays(spark: SparkSession, rows, names: Sequence[str] = ("src", "rel", "dst")) -> DataFrame:
    """Edges from a two-dimensional array (anything numpy takes) in memory."""
    import numpy as np

    held = np.asarray(rows)
    return spark.createDataFrame(pa.table({n: pa.array(held[:, i].astype("int64")) for i, n in enumerate(names)}))


READERS: dict[str, Callable[..., DataFrame]] = {n: scan_delimited for n in DELIMITED} | {n: scan_arrays for n in ARRAYS}


def scan(spark: SparkSession, source, kind: str, **options) -> DataFrame:
    """Edges by the name of the format."""
    if kind.upper() not in READERS:
        raise ValueError(f"no reader for {kind}; there are {sorted(READERS)}")
    return READERS[kind.upper()](spark, source, **options)


#: Named datasets: places of src, rel, dst in their files, separator, header lines, and whether splits are given.
DATASETS = {
    "fb15k": ((0, 1, 2), "\t", 0, True), "fb15k_237": ((0, 1, 2), "\t", 0, True), "livejournal": ((0, 1), "\t", 4, False), "friendster": ((0, 1), "\t", 4, False), "twitter": ((0, 1), " ", 0, False),
    "freebase86m": ((0, 2, 1), "\t", 0, True), "ogbl_wikikg2": ((0, 1, 2), ",", 0, True), "ogbl_citation2": ((0, 1), ",", 0, True), "ogbl_ppa": ((0, 1), ",", 0, True), "ogb_wikikg90mv2": ((0, 1, 2), ",", 0, True), "wikidata5m": ((0, 1, 2), "\t", 0, True),
    "ogbn_arxiv": ((0, 1), ",", 0, False), "ogbn_products": ((0, 1), ",", 0, False), "ogbn_papers100m": ((0, 1), ",", 0, False), "ogb_mag240m": ((0, 1), ",", 0, False),
}


def load_dataset(spark: SparkSession, name: str, train: str, valid: str | None = None, test: str | None = None) -> dict[str, DataFrame]:
    """Edges by split of a named dataset whose files lie at the given paths; "custom" takes three columns of tabs."""
    columns, sep, header, given = DATASETS.get(name, ((0, 1, 2), "\t", 0, True))
    if given and name in DATASETS and not (valid and test):
        raise ValueError(f"{name} comes with train, valid and test files")
    return {k: scan_delimited(spark, p, columns, sep, header) for k, p in (("train", train), ("valid", valid), ("test", test)) if p}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """at, line: the lines of a text file and their places (from 0)."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    return positions(lines, ["_start", "_line"], "at").select("at", "line")


def load_node_dataset(spark: SparkSession, name: str, edges: str, splits: dict[str, str], features: str | None = None, labels: str | None = None) -> dict[str, DataFrame]:
    """Tables of a named dataset for node classification whose files lie at the given paths.

    edges (src, dst, and rel for typed ones), known (raw: every node of the edges and of the splits), split (raw, split),
    features (raw, vec) and labels (raw, label). ``splits``: files of node ids by split. Line i of the features' and
    the labels' file is that of node i; numbers are parted by commas.
    """
    columns, sep, header, _ = DATASETS[name]
    rows = scan_delimited(spark, edges, columns, sep, header)
    parts = [spark.read.text(path).where("trim(value) != ''").select(F.trim("value").alias("raw"), F.lit(split).alias("split")) for split, path in splits.items()]
    split = reduce(DataFrame.unionByName, parts)
    known = rows.select(F.col("src").alias("raw")).union(rows.select("dst")).union(split.select("raw")).distinct()
    out = {"edges": rows, "known": known, "split": split}
    raw = F.col("at").cast("string").alias("raw")
    if features:
        out["features"] = numbered_lines(spark, features).select(raw, F.split("line", ",").cast("array<double>").alias("vec"))
    if labels:
        out["labels"] = numbered_lines(spark, labels).select(raw, F.trim("line").cast("double").cast("int").alias("label"))
    return out


def remap_node_dataset(tables: dict[str, DataFrame], nodes: DataFrame) -> dict[str, DataFrame]:
    """The tables with ids of the dictionary ``nodes`` (raw, id) in place of raw ones; nodes without features or labels
    have no row there."""
    named = lambda df: df.join(nodes, "raw").select("id", *[c for c in df.columns if c != "raw"])
    edges = tables["edges"]
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("raw").alias(end), F.col("id").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return {"edges": edges.select(tables["edges"].columns)} | {k: named(v) for k, v in tables.items() if k != "edges"}


def capture(batches: DataFrame, path: str, most: int | None = None) -> None:
    """Write the ids of batches (batch, at, id) to replay them later; the first ``most`` batches, or all."""
    (batches if most is None else batches.where(F.col("batch") < most)).select("batch", "at", "id").write.mode("overwrite").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """batch, at, id as captured."""
    return spark.read.parquet(path)


def write_edges(bucketed: DataFrame, path: str, stats: dict | None = None) -> None:
    """Edges by bucket as a partitioned table, which scans of a state's buckets prune, with its statistics beside it."""
    bucketed.write.partitionBy("src_part", "dst_part").parquet(path)
    if stats is not None:
        spark = bucketed.sparkSession
        spark.createDataFrame([(json.dumps(stats, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}.stats")


def read_stats(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.stats").first().value)


def read_range(edges: DataFrame, first: int, n: int) -> DataFrame:
    return edges.where((F.col("edge_id") >= first) & (F.col("edge_id") < first + n))


def gather(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of ``table`` (id, ...) for each row of ``ids`` (id, ...), repeats included."""
    return ids.join(table, "id")


def upsert(table: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``table`` (id, ...) with the values of ``changes`` (id, ``columns``) where there are any."""
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(new, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def accumulate(table: DataFrame, deltas: DataFrame, column: str = "emb") -> DataFrame:
    """``table`` (id, ``column``) with the vectors of ``deltas`` (id, delta) added, repeated ids summed first."""
    summed = deltas.groupBy("id").agg(sum_vectors("delta", dimension(table, column)).alias("_delta"))
    added = F.when(F.col("_delta").isNull(), F.col(column)).otherwise(F.zip_with(column, "_delta", lambda a, b: a + b))
    return table.join(summed, "id", "left").select(*[added.alias(c) if c == column else F.col(c) for c in table.columns])


def save_checkpoint(tables: dict[str, DataFrame], path: str, version: int, about: dict) -> None:
    """Tables and then the note that names the version: a version without its note was never finished."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(about | {"version": version, "tables": sorted(tables)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/v{version}/about")


def load_checkpoint(spark: SparkSession, path: str, version: int) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.text(f"{path}/v{version}/about").first().value)
    return {name: spark.read.parquet(f"{path}/v{version}/{name}") for name in about["tables"]}, about


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_edge_ids(edges: DataFrame, order: Sequence[str]) -> DataFrame:
    """``edges`` with edge_id, their place (from 0) in ``order``."""
    return positions(edges, list(order), "edge_id")


def write_scores(df: DataFrame, path: str) -> None:
    """Scores, labels or metrics as text files with a header."""
    df.write.mode("overwrite").csv(path, header=True)
