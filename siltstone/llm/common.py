"""What the operators share: code shipping, shared scratch tables, size-checked joins and names that clash with none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shipping
from ..operators.scratch import drop_scratch, materialize, scratch_path, scratch_root

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000

#: Words of every operator here: runs of bytes other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Tasks that a bounded sample of training rows is dealt to.
SAMPLE_PARTS = 8


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches small where the session has Spark's own size."""
    shipping.small_batches(spark)
    shipping.ship(spark)


def small_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side of a checked size: broadcast up to `limit` rows, else a shuffled join that AQE can split."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores as make it differ from all columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain(columns: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def crc_bucket(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def add_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["BROADCAST_ROWS", "SAMPLE_PARTS", "WORD", "add_columns", "crc_bucket", "drop_scratch", "free_name", "materialize", "plain", "read", "scratch_path", "scratch_root", "ship", "small_join"]
