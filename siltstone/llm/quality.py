"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

One pass counts every character ORDER-gram of the corpus (an exact 64-bit number: four 16-bit characters) and how often
it occurs in trusted texts. Discounts, history sums and continuation counts come from aggregates over these counts;
joins on histories and suffixes, sharded by gram like the counts, give the probability of every gram of the corpus. A
text's perplexity is that of its characters. A text is kept if its perplexity is at most a quantile of the trusted
texts' in its language; of these, only the texts of fold 0 (by hash of the id), which the model has not seen.

What is gathered grows with the corpus: all grams of all texts. The gram table is sent to the scoring pass as a whole
only if it was counted and has at most `table_grams` rows (12 bytes each); beyond that, counts per text and gram are
joined with it by shuffle. Both ways give the same perplexities.

Edge cases: null and empty texts have no grams, a null perplexity, and are kept (there is nothing against them);
a null lang is a language of its own; a language with too few trusted texts in fold 0 for the quantile to differ from
their maximum takes the quantile over its other trusted texts too, one without any the quantile over all languages;
with no trusted text at all everything is kept; characters beyond U+FFFE stand for one of
6,400 private ones each, by their remainder, so that two of them seldom meet; texts of any length are read in groups of
characters; other columns are not read, whatever their names; an id that is trusted twice counts once;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, materialize, ship, small_join
from .ngrams import Counts, groups

ORDER = 4
#: First private character and their number (fixed values).
PRIVATE, PRIVATE_SIZE = 0xE000, 6400
QUANTILE = 0.995
TABLE_GRAMS = 4_000_000
#: Trusted ids (8 bytes) are broadcast up to this count, else joined by shuffle.
BROADCAST_IDS = 1_000_000


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts' grams as numbers, one per character, and the part of each. Every part starts after ORDER - 1 blanks."""
    pad = "\x00" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(parts)).encode("utf-32-le", "replace"), np.uint32)
    raw = np.where(raw < 0xFFFF, raw, PRIVATE + raw % PRIVATE_SIZE).astype(np.uint64)
    sizes = np.array([len(p) for p in parts])
    start = np.cumsum(sizes + ORDER - 1) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[part]
    g = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        g |= raw[at - k] << np.uint64(16 * k)
    return g.view(np.int64), part


def _count(batches):
    counts = Counts()
    row = lambda got: pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["g", "n"])
    for batch in batches:
        trusted = np.array(batch.column(1).to_pylist(), np.int64)
        for index, parts in groups(batch.column(0).to_pylist()):
            g, part = grams(parts)
            counts.add(g, trusted[np.array(index)][part])
            if got := counts.full():
                yield row(got)
    if got := counts.rest():
        yield row(got)


def _low(order: int) -> str:
    return f"g & {(1 << 16 * order) - 1}"


def _level(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """counts (g, n) of one order to (g, direct share) and (history, sum and weight left for lower orders)."""
    r = counts.agg(*[F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).first()
    t1, t2, t3, t4 = (float(r[f"t{k}"]) for k in (1, 2, 3, 4))
    y = t1 / (t1 + 2 * t2) if t1 else 0.5
    d = [min(k, max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 * k for k, a, b in ((1, t1, t2), (2, t2, t3), (3, t3, t4))]
    discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    keyed = counts.withColumn("h", F.expr("shiftrightunsigned(g, 16)")).withColumn("d", discount)
    past = keyed.groupBy("h").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
    direct = keyed.join(past.select("h", "total"), "h").select("g", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"))
    return direct, past.select("h", "left")


def gram_table(counted: DataFrame) -> DataFrame:
    """counted (g, n: occurrences in trusted texts, 0 allowed) to (g, logp) for every g."""
    levels, counts = {}, counted.filter("n > 0")
    for order in range(ORDER, 0, -1):
        levels[order] = _level(counts, order)
        if order > 1:  # continuation counts: how many characters a suffix follows
            counts = materialize(counts.withColumn("s", F.expr(_low(order - 1))).groupBy("s").agg(F.count("*").alias("n")).withColumnRenamed("s", "g"), "continuations")
    out = counted.select("g", F.lit(1.0 / (1 << 16)).alias("p"))
    for order in range(1, ORDER + 1):
        direct, past = levels[order]
        out = out.withColumn("_g", F.expr(_low(order)) if order < ORDER else F.col("g")).withColumn("_h", F.expr("shiftrightunsigned(_g, 16)"))
        out = small_join(out, direct.select(F.col("g").alias("_g"), F.col("p").alias("_p")), ["_g"])
        out = small_join(out, past.select(F.col("h").alias("_h"), F.col("left").alias("_left")), ["_h"])
        # An unseen history leaves all weight to the lower order.
        out = out.select("g", (F.coalesce("_p", F.lit(0.0)) + F.coalesce("_left", F.lit(1.0)) * F.col("p")).alias("p"))
    return out.select("g", F.log("p").alias("logp"))


def _scorer(shared, where: int):
    def run(batches):
        keys, logp = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                total, chars = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for index, parts in groups(batch.column(where).to_pylist()):
                    g, part = grams(parts)
                    of = np.array(index)[part]
                    total += np.bincount(of, logp[np.searchsorted(keys, g)], batch.num_rows)
                    chars += np.bincount(of, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(chars), pa.array(total)], names=["doc_id", "lang", "trusted", "grams", "logp"])

    return run


def _per_text(batches):
    """(row, text) to (row, g, k): how often a text has each gram."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for index, parts in groups(batch.column(1).to_pylist()):
            g, part = grams(parts)
            order = np.lexsort((g, part))
            g, part = g[order], part[order]
            cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (part[1:] != part[:-1]))) if len(g) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[np.array(index)[part[cut]]]), pa.array(g[cut]), pa.array(np.diff(np.append(cut, len(g))))], names=["row", "g", "k"])


def score(documents: DataFrame, trusted: DataFrame, table_grams: int = TABLE_GRAMS, leave_out: bool = False) -> DataFrame:
    """doc_id, lang, trusted (1: learned from, 2: left out), grams, perplexity. trusted: doc_id of the trusted texts, of which
    leave_out keeps those of fold 0 from the model."""
    spark = documents.sparkSession
    ship(spark)
    ids = trusted.filter("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("trusted", F.when(F.lit(leave_out) & (crc_bucket(F.col("doc_id")) == 0), 2).otherwise(1))
    marked = small_join(documents.select("doc_id", "lang", "text"), ids, ["doc_id"], "left", BROADCAST_IDS).select("doc_id", "lang", F.coalesce("trusted", F.lit(0)).alias("trusted"), "text")
    counted = materialize(marked.select("text", F.expr("int(trusted = 1)").alias("learn")).mapInArrow(_count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "gram-counts")
    table = materialize(gram_table(counted), "gram-table")
    if table.limit(table_grams + 1).count() <= table_grams:
        got = table.toArrow()
        keys, logp = got["g"].to_numpy(), got["logp"].to_numpy()
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], logp[order].astype(np.float32)))
        scored = marked.select("doc_id", "lang", "trusted", "text").mapInArrow(_scorer(shared, 3), "doc_id long, lang string, trusted int, grams long, logp double")
    else:
        rows = materialize(marked.withColumn("row", F.monotonically_increasing_id()), "numbered")
        sums = rows.select("row", "text").mapInArrow(_per_text, "row long, g long, k long").join(table, "g").groupBy("row").agg(F.sum("k").alias("grams"), F.sum(F.col("k") * F.col("logp").cast("float")).alias("logp"))
        scored = rows.drop("text").join(sums, "row", "left").select("doc_id", "lang", "trusted", F.coalesce("grams", F.lit(0)).alias("grams"), "logp")
    return scored.withColumn("perplexity", F.when(F.col("grams") > 0, F.exp(-F.col("logp") / F.col("grams")))).drop("logp")


def classify(documents: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """doc_id, lang, grams, perplexity, threshold, kept."""
    scored = materialize(score(documents, trusted, table_grams, leave_out=True), "perplexities")
    good = scored.filter("trusted > 0 AND perplexity IS NOT NULL")
    key = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("-"))
    unseen = F.when(F.col("trusted") == 2, F.col("perplexity"))
    # Below this count a quantile is the maximum.
    least = round(1 / (1 - quantile)) if quantile < 1 else 1
    own = F.when(F.count(unseen) >= least, F.percentile_approx(unseen, quantile, 100_000)).otherwise(F.percentile_approx("perplexity", quantile, 100_000))
    limits = good.withColumn("_key", key).groupBy("_key").agg(own.alias("_own"))
    overall = good.agg(own).first()[0]
    out = small_join(scored.withColumn("_key", key), limits, ["_key"])
    out = out.withColumn("threshold", F.coalesce("_own", F.lit(overall).cast("double")))
    return out.select("doc_id", "lang", "grams", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
