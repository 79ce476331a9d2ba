"""Degrees over a stream of edge files: an extension, with no counterpart in batch systems of this kind.

Each micro-batch is summed and folded into a table of degrees, written as a new version; a version is named after
its batch, so that a batch that runs again writes the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.dictionary import node_degrees


def degree_stream(spark: SparkSession, edges_path: str, schema: str, out: str, files_per_batch: int = 1) -> StreamingQuery:
    """Start a query that folds new edge files into ``out``/v<batch>."""
    edges = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(edges_path)

    def fold(batch: DataFrame, number: int) -> None:
        now = node_degrees(batch)
        if number:
            now = now.unionByName(batch.sparkSession.read.parquet(f"{out}/v{number - 1}")).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("out_degree", "in_degree", "degree")])
        now.write.mode("overwrite").parquet(f"{out}/v{number}")

    return edges.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Windowed counts and sums of an event stream (ts, event_type, value) with late rows dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")
