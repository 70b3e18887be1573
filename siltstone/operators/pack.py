"""Packing ranked pieces into a budget of characters. Both rules keep a prefix of the ranking: the first piece that
does not fit ends it. Groups that are too large for a task, null ones too, are summed over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import earlier, fit_tasks, ranged, ranges_for, same

#: Rows whose texts are joined at once.
PART = 4096


def joined_within(df: DataFrame, group: list[str], rank: str, text: str, budget: int) -> DataFrame:
    """Keep rows whose text, joined to those before it by blank lines (two characters, charged to the first piece as
    well), stays within the budget. Totals never fall along the ranking, so what is kept is a prefix."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    sums = earlier(df, group, [rank], [text], _chars=size, _rows=F.lit(1))
    # Empty leading pieces add no separator: those count from the first piece that has text.
    started = F.col("_chars") > 0
    lead = sums.filter(~started).groupBy(*group).agg(F.count("*").alias("_lead"))
    sums = same(sums, lead, group, "left")
    separators = F.when(started, F.col("_rows") + 1 - F.col("_lead")).otherwise(1)
    kept = sums.filter(F.col("_chars") + size + 2 * separators <= budget)
    return kept.select(*df.columns)


def snippet(relpath: Column, idx: Column, content: Column) -> Column:
    return F.concat(relpath, F.lit(":"), idx.cast("string"), F.lit("\n"), content, F.lit("\n"))


def snippets_within(df: DataFrame, group: list[str], rank: str, piece: str, budget: int) -> DataFrame:
    """Keep rows while the pieces' lengths add up to at most the budget; separators are not charged."""
    sums = earlier(df, group, [rank], [piece], _chars=F.coalesce(F.length(piece), F.lit(0)))
    return sums.filter(F.col("_chars") + F.coalesce(F.length(piece), F.lit(0)) <= budget).select(*df.columns)


def context_text(df: DataFrame, group: list[str], rank: str, text: str, sep: str = "\n\n") -> DataFrame:
    """One text per group, in rank order, gathered at once: for groups that a budget or the caller bounds."""
    return df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))), lambda x: x["t"]), sep).alias("context"))


def gathered_text(df: DataFrame, group: list[str], rank: str, text: str, sep: str = "\n\n") -> DataFrame:
    """context_text for groups of any number of rows: joined in parts of at most PART rows, which are spread over ranges;
    only a group's parts, joined already, come together. The text itself is one value."""
    if fit_tasks(df, group, [text]):
        return context_text(df, group, rank, text, sep)
    rows = ranged(df.select(*group, rank, text), group, [rank, text], ranges_for(df, [text])).withColumn("_part", F.floor(F.col("_k") / PART))
    joined = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.col("t")))), lambda x: x["t"])
    # A part without any text is null, so that it adds no separator.
    parts = rows.filter(F.col(text).isNotNull()).withColumn("t", F.col(text)).groupBy(*group, "_range", "_part").agg(F.array_join(joined("_k"), sep).alias("t"))
    empty = rows.groupBy(*group).agg(F.lit(None).cast("string").alias("t")).select(*group, F.lit(-1).cast("long").alias("_range"), F.lit(0).cast("long").alias("_part"), "t")
    return parts.unionByName(empty).groupBy(*group).agg(F.array_join(joined("_range", "_part"), sep).alias("context"))
