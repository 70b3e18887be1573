"""Order inside groups of any size: rows are dealt by ranges of (group, order), so that no task holds a whole group."""

from __future__ import annotations

import threading
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize

#: Spark draws so many rows a partition to find the bounds of ranges; bounds are drawn from whole texts here.
SAMPLE, DRAWN = "spark.sql.execution.rangeExchange.sampleSizePerPartition", "20"


#: Groups of at most so many rows and bytes of text are left to one task's window.
GROUP_ROWS, GROUP_BYTES = 100_000, 32 << 20


#: Bytes of text that a range holds, about.
RANGE_BYTES = 64 << 20


def fit_tasks(df: DataFrame, group: list[str], texts: list[str]) -> bool:
    """Is every group small enough for one task? Both ways give the same rows; ranges cost a write and a sort of all of them."""
    return _sizes(df, group, texts)[0]


def ranges_for(df: DataFrame, texts: list[str]) -> int:
    """How many ranges rows with these texts are dealt to, by their size and the session's number of partitions at least."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(t).cast("string")), F.lit(0)) for t in texts], F.lit(16).cast("long"))
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def _sizes(df: DataFrame, group: list[str], texts: list[str]) -> tuple[bool, int]:
    """Do all groups fit a task, and the bytes of all; counted by an aggregate that is combined before its shuffle."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(t).cast("string")), F.lit(0)) for t in texts], F.lit(0).cast("long"))
    each = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    most = each.agg(F.max("n").alias("n"), F.max("b").alias("b"), F.sum(F.col("b") + 16 * F.col("n")).alias("all")).first()
    return (most["n"] or 0) <= GROUP_ROWS and (most["b"] or 0) <= GROUP_BYTES, most["all"] or 0


_setting = threading.RLock()


@contextmanager
def few_samples(spark: SparkSession):
    """Bounds of ranges are drawn from few rows while this lasts, so that whole texts among them keep the driver small. The
    setting is the session's: threads that share one take turns."""
    with _setting:
        held = spark.conf.get(SAMPLE)
        spark.conf.set(SAMPLE, DRAWN)
        try:
            yield
        finally:
            spark.conf.set(SAMPLE, held)


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls being equal; the columns of the left stay."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    joined = left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]), how)
    return joined.drop(*[f"_r_{c}" for c in on])


def ranged(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df, written once, with _range and _k: rows stand in order of group and `order` (nulls first) over ranges, then over k.
    Equal rows stand in any order and may be parted. parts: the number of ranges, the session's partitions by default."""
    spark = df.sparkSession
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*group, *order, "_tie"]]
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The id of a row is its partition, 33 bits to the left, and its place in there.
    rows = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    with few_samples(spark):
        return materialize(rows.withColumns({"_range": F.shiftright("_id", 33), "_k": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ranged")


def running(rows: DataFrame, group: list[str], amount: Column | None = None) -> DataFrame:
    """Of ranged rows: _before, the sum of `amount` (1 by default) over the group's earlier rows, _total over all of
    them, and _low, the group's first k in its range."""
    rows = rows.withColumn("_amount", (F.lit(1) if amount is None else amount).cast("long"))
    sums = rows.groupBy(*group, "_range").agg(F.sum("_amount").alias("_s"), F.min("_k").alias("_low"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*group, "_range", "_low", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"), F.sum("_s").over(W.partitionBy(*group)).alias("_total"))
    inside = W.partitionBy(*group, "_range").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("_in", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return same(summed, base, [*group, "_range"]).withColumn("_before", F.col("_base") + F.col("_in")).drop("_amount", "_in", "_base")


def earlier(df: DataFrame, group: list[str], order: list[str], texts: list[str], **amounts: Column) -> DataFrame:
    """df with, for each amount, the sum over the group's earlier rows by `order` (nulls first) under its name, and the
    group's whole sum under that name with `_all`. In one window where all groups fit a task, else over ranges."""
    fits, size = _sizes(df, group, texts)
    if fits:
        whole = W.partitionBy(*group)
        before = whole.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
        sums = {name: F.coalesce(F.sum(a.cast("long")).over(before), F.lit(0)) for name, a in amounts.items()}
        return df.withColumns(sums | {f"{name}_all": F.sum(a.cast("long")).over(whole) for name, a in amounts.items()})
    rows = ranged(df, group, order, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    for name, amount in amounts.items():
        rows = running(rows, group, amount).withColumnsRenamed({"_before": name, "_total": f"{name}_all"}).drop("_low")
    return rows.drop("_range", "_k")
