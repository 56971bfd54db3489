"""Tables staged in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: list[str] = []
#: Paths staged within each open :func:`scratch`, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="staged-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation.

    The table goes when the application ends, or earlier by :func:`drop_staged` or with its :func:`scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    # Spark removes the files of shuffles that nobody refers to any more, but only once the driver's heap is collected
    spark._jvm.System.gc()
    # a written schema has every column nullable
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove a table written by :func:`stage` that no plan reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables staged inside at its end, but those staged by the function it yields."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        staged = stage(df, name)
        path = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(path)
        return staged

    _scopes.append([])
    try:
        yield keep
    finally:
        for path in _scopes.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
