"""What the operators share of the cluster: code on the executors, written tables, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.shared import cut, discard_on_exit, narrowed, release, shared_folder, ship

__all__ = ["bound_batches", "bounded_sample", "crc_mod", "cut", "discard_on_exit", "map_arrow", "narrowed", "places", "release", "shared_folder", "ship", "take"]

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to about 8 MB (or one row), so that a task's memory doesn't depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that yields batches."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from function(batch)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a worker has freed to the system at a task's end: workers live on, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value's text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the smallest hashed ``key``, or all if there are fewer.

    A bound on the hash leaves a few more than n rows before any are sorted, however large the table is.
    """
    total = rows.count()
    share = min(1.0, (n + 10 * n**0.5 + 10) / max(total, 1))
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    return rows.where(place <= min(int(share * 2.0**63), 2**63 - 1)).orderBy(place, key).limit(n)


def places(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` with columns named by their places, these names by a column's own, and all of them in order.

    Own names are looked up as they are written, or else in any case; of columns that share one the first counts.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    found = {c.lower(): i for c, i in reversed(list(zip(df.columns, inner, strict=True)))}
    return df.toDF(*inner), found | dict(reversed(list(zip(df.columns, inner, strict=True)))), inner


def take(df: DataFrame, *names: str) -> DataFrame:
    """Columns by name, whatever others there are."""
    plain, place, _ = places(df)
    return plain.select(*[F.col(place[n]).alias(n) for n in names])
