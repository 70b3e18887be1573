"""Mixing sources to target weights.

Sizes are summed per source; targets share the whole corpus by weight, and no source is repeated beyond a limit. A
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.
Of a few hash seeds each source takes the one whose Bernoulli copies come nearest to its target, so that small
sources meet their targets too.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated ids get the same
copies (the seed is the id), a null id counts as the empty id; an empty table gives an empty result; all columns pass
through unchanged, whatever their names: results are in one struct column, named `mix` or, where that is taken, the first
free of mix_, mix__ and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import ranged, running
from .common import WORD, free_name, materialize, plain, small_join

#: Hash seeds tried for each source.
SEEDS = 32
#: Hash values are whole numbers under this.
HASH_RANGE = 1 << 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _draw(doc_id: Column, seed: Column) -> Column:
    """A uniform whole number under HASH_RANGE from the id and the seed: 32 bits of MD5, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    `sizes` has source and size. Sources in code point order, null last, take the weights in turn. The excess over
    `limit` times a source's size is shared again by weight until no target is above: each round is one small
    aggregate, so the sources themselves never go to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.isnull("source"))
    # Sources are numbered over ranges of them: there may be as many as hosts.
    per = running(ranged(per, [], ["_last", "source"]), []).withColumnRenamed("_before", "_n").withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long"))
    per = materialize(per.select("source", "source_size", "_n", "_w"), "sources")
    cap = F.col("source_size") * limit
    free, spare, by = None, None, None
    while True:
        open_ = F.lit(True) if free is None else cap * F.lit(by) >= F.col("_w") * F.lit(spare)
        r = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(~open_, cap).otherwise(0)).alias("capped"), F.sum(F.when(open_, F.col("_w")).otherwise(0)).alias("by"), F.sum(F.when(open_, 1).otherwise(0)).alias("free")).first()
        if not r["free"] or r["free"] == free:
            break
        free, spare, by = r["free"], float(r["total"] - r["capped"]), float(r["by"])
    share = F.col("_w") * F.lit(spare or 0.0) / F.lit(by or 1.0)
    return per.select("source", "source_size", F.when(cap * F.lit(by or 1.0) >= F.col("_w") * F.lit(spare or 0.0), share).otherwise(cap.cast("double")).alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seeds: int = SEEDS) -> DataFrame:
    """documents plus, as the last column, a struct of size, source_size, target and copies (how often the mix takes it)."""
    keyed = lambda source: F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))
    sizes = materialize(documents.select("doc_id", keyed(F.col("source")).alias("key"), "source", words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.select(keyed(F.col("source")).alias("key"), "source_size", "target", F.floor(rate).cast("long").alias("whole"), ((rate - F.floor(rate)) * float(HASH_RANGE)).alias("odds"))
    tries = small_join(sizes.select("doc_id", "key", "size"), targets.select("key", "odds"), ["key"], "inner")
    sums = tries.groupBy("key").agg(*[F.sum(F.when(_draw(F.col("doc_id"), F.lit(s)) < F.col("odds"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(seeds)])
    got = F.array(*[F.struct(F.abs(F.col("source_size") * F.col("whole") + F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(seeds)])
    key, rates = free_name(documents.columns, "_key"), free_name(documents.columns, "_rates")
    plan = targets.join(sums, "key").select(F.col("key").alias(key), F.struct("source_size", "target", "whole", "odds", F.array_min(got)["seed"].alias("seed")).alias(rates))
    # Only sizes and ids were needed so far; the texts are read once more, and no document moves.
    out = small_join(documents.withColumn(key, keyed(F.col("source"))), materialize(plan, "rates"), [key], "left")
    r = F.col(rates)
    copies = r["whole"] + (_draw(F.col("doc_id"), r["seed"]) < r["odds"]).cast("long")
    found = F.struct(words(F.col("text")).alias("size"), r["source_size"].alias("source_size"), r["target"].alias("target"), copies.alias("copies"))
    return out.select(*plain(documents.columns), found.alias(free_name(documents.columns, "mix")))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document, without the struct that mix() added, as often as the mix takes it."""
    *columns, name = mixed.columns
    taken = mixed.filter(F.col(name)["copies"] > 0)
    return taken.select(*plain(columns), F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int"))).alias(name)).select(*plain(columns))
