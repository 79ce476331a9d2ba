"""The package's code on the executors, and tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_own_folder: list[str] = []
_shipped: set[str] = set()


@cache
def _archive() -> tuple[bytes, str]:
    """This package as a zip archive, and its digest."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(path.relative_to(PACKAGE.parent))), path.read_bytes())
    return held.getvalue(), hashlib.sha256(held.getvalue()).hexdigest()[:16]


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors by the shared folder, once for each context."""
    context = spark.sparkContext
    if (key := context.applicationId) in _shipped:
        return
    data, digest = _archive()
    name = f"{shared_folder(spark)}/weftgraph-{digest}-{uuid.uuid4().hex[:8]}.zip"
    files, path = _file_system(spark, name)
    out = files.create(path)
    out.write(bytearray(data))
    out.close()
    files.deleteOnExit(path)
    context.addPyFile(name)
    _shipped.add(key)


def _file_system(spark: SparkSession, name: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, an own folder if driver and executors are one process, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="weftgraph-"))
    return _own_folder[0]


def new_path(spark: SparkSession, suffix: str = "parquet") -> str:
    return f"{shared_folder(spark)}/weftgraph-{uuid.uuid4().hex}.{suffix}"


def discard_on_exit(spark: SparkSession, name: str) -> None:
    """Delete a written table when the driver's process ends."""
    files, path = _file_system(spark, name)
    files.deleteOnExit(path)


def cut(df: DataFrame, narrow: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows as a written table: what reads them later doesn't run ``df`` again, and lost executors lose none.

    ``narrow``: of a table that is far smaller than what it is made from, that many shuffle partitions go to one file.
    ``by``: columns by whose values the table lies in folders, which filters on them prune.
    The table is deleted by ``release``, or else when the driver's process ends, since results are read lazily.
    """
    spark = df.sparkSession
    path, schema = new_path(spark), df.schema
    if narrow > 1:
        df = narrowed(df, narrow)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    discard_on_exit(spark, path)
    table = spark.read.schema(schema).parquet(path)
    table._written_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more; other tables are left alone."""
    for table in tables:
        if name := vars(table).get("_written_at"):
            files, path = _file_system(table.sparkSession, name)
            files.delete(path, True)


def narrowed(df: DataFrame, by: int) -> DataFrame:
    """``df`` in a ``by``-th of the session's shuffle partitions, without another shuffle."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // by))
