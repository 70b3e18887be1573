"""Tables in the shared scratch folder, which cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. A folder of our own only with a local master: on a cluster no folder but the
    named one is known to be shared."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local"):
        os.makedirs(_own(), exist_ok=True)
        return _own()
    raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith(_own()):
            shutil.rmtree(path, ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            _remove(spark, path)
    except Exception:  # the session is gone already: the cluster's own expiry clears the folder
        pass


def _own() -> str:
    return os.path.join(tempfile.gettempdir(), "siltstone-scratch")


#: Open scopes of the running thread or task, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables made while this lasts go at its end, but for those that the caller takes out of the list it gets.

    Only for work that is done then: whatever still has to be computed may need them.
    """
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)
        for path in made:
            _remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/siltstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_cleanup, spark, path)
    for made in _scopes.get()[-1:]:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Remove scratch tables that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            if "/siltstone-" in folder:
                _remove(df.sparkSession, folder)
