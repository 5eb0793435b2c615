"""Session helpers: worker imports and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_made: list[str] = []
#: The folders made within the innermost ``scratch`` of this thread, by the name of each table.
_scope: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("scope", default=None)


def ship(spark: SparkSession) -> None:
    """Give this package's source to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "verbaspark_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("verbaspark", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset, one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/verbaspark-checkpoints"
    out = f"{base.rstrip('/')}/verbaspark-{uuid.uuid4().hex}"
    _made.append(out)
    return out


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there.

    The committed files outlive lost executors, and later scans read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append((path, out))
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized inside are deleted at the end, but for those given to the function that this yields.

    For steps whose results are written by then; nothing that is read later may still need a deleted table."""
    scope: list[tuple[str, DataFrame]] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _scope.set(scope)
    try:
        yield keep
    finally:
        _scope.reset(token)
        outer = _scope.get()
        for path, df in scope:
            if any(df is k for k in kept):
                if outer is not None:
                    outer.append((path, df))
            else:
                _delete(spark, path.rpartition("/")[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def release(spark: SparkSession) -> None:
    """Delete all tables made in this process that are left; call it once no result is read any more that needs one."""
    for folder in list(_made):
        _delete(spark, folder)
