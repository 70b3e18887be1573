"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation several times, each time with a few turns more. Every turn's prefix gets a hash that
rolls on: the exclusive or of the hashes of (position, role, text) up to it, twice with different seeds, so 128 bits.
A conversation whose full hash is a shorter prefix's hash in a longer one goes; of equal ones the smallest conv_id
stays. What is left is rendered.

All rows are dealt by ranges of (conversation, turn, role, text) and then by row, so that a conversation with a large share
of all rows, or many rows of one turn number, is spread over ranges. Positions and prefixes add up over the ranges of a
conversation first and inside a range then; no window, join or text holds a whole conversation. Rendering gives one row
per STRIDE positions, nearly always one per conversation.

Edge cases: null roles and texts are different from empty ones and render empty; turns that share a number stand in
order of role and text, a null number first; repeated rows are further turns; rows with a null conv_id are one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_join

STRIDE = 512
SAMPLE = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


#: A conversation's key: its id with 0 for null, and whether it is null. Two plain columns, so that windows, aggregates
#: and joins on them share one partitioning.
KEY = ["_conv", "_null"]


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, KEY, range, k (from 0 inside the range), role, text and two hashes c, d of role and text; in order over all ranges."""
    spark = turns.sparkSession
    marks = [F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    # Equal rows may stand in any order; their place in the input parts them, so that they need not share a range.
    cols = turns.select("conv_id", F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.isnull("conv_id").alias("_null"), "turn", "role", "text").withColumn("tie", F.monotonically_increasing_id())
    order = [*map(F.col, KEY), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("tie")]
    ranges = cols.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)
    # The id of a row is its partition, 33 bits to the left, and its place in there.
    rows = ranges.withColumn("id", F.monotonically_increasing_id()).select("conv_id", *KEY, F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"), "role", "text", F.xxhash64(*marks).alias("c"), F.xxhash64(F.lit("second"), *marks).alias("d"))
    # Range bounds are drawn from whole texts: a smaller sample than Spark's keeps the driver small.
    held = spark.conf.get(SAMPLE)
    spark.conf.set(SAMPLE, "20")
    try:
        return materialize(rows, "turns")
    finally:
        spark.conf.set(SAMPLE, held)


def starts(rows: DataFrame) -> DataFrame:
    """KEY, range, low (k of the conversation's first turn there), base (its turns in earlier ranges) and turns (all of them)."""
    size = rows.groupBy(*KEY, "range").agg(F.count("*").alias("n"), F.min("k").alias("low"))
    all_ = W.partitionBy(*KEY)
    return size.select(*KEY, "range", "low", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("base"), F.sum("n").over(all_).alias("turns"))


def _before():
    return W.partitionBy(*KEY).orderBy("range").rowsBetween(W.unboundedPreceding, -1)


def prefixes(rows: DataFrame, first: DataFrame) -> DataFrame:
    """KEY, turns, size and the hashes p, q of the prefix of so many turns that ends with each turn."""
    at = rows.select(*KEY, "range", "k", "c", "d").join(first, [*KEY, "range"]).withColumn("size", F.col("base") + F.col("k") - F.col("low") + 1)
    hashed = at.select(*KEY, "range", "turns", "size", F.xxhash64("size", "c", "d").alias("h"), F.xxhash64("d", "c", "size", F.lit("second")).alias("g"))
    sums = hashed.groupBy(*KEY, "range").agg(F.expr("bit_xor(h)").alias("h"), F.expr("bit_xor(g)").alias("g"))
    carry = sums.select(*KEY, "range", F.coalesce(F.expr("bit_xor(h)").over(_before()), F.lit(0)).alias("hb"), F.coalesce(F.expr("bit_xor(g)").over(_before()), F.lit(0)).alias("gb"))
    upto = W.partitionBy(*KEY, "range").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    rolled = hashed.select(*KEY, "range", "turns", "size", F.expr("bit_xor(h)").over(upto).alias("hi"), F.expr("bit_xor(g)").over(upto).alias("gi"))
    return rolled.join(carry, [*KEY, "range"]).select(*KEY, "turns", "size", F.col("hi").bitwiseXOR(F.col("hb")).alias("p"), F.col("gi").bitwiseXOR(F.col("gb")).alias("q"))


def maximal(rows: DataFrame) -> DataFrame:
    """KEY and turns of the conversations that are no prefix of a longer one, one of each."""
    # Of equal conversations the smallest id stays; one without an id yields to any that has one.
    one = rows.filter("size = turns").groupBy("turns", "p", "q").agg(F.min(F.struct("_null", "_conv")).alias("first")).select("turns", "p", "q", "first._conv", "first._null")
    # A turn that is not its conversation's last ends a prefix of a longer one.
    prefix = rows.filter("size < turns").select(F.col("size").alias("turns"), "p", "q").distinct()
    return one.join(prefix, ["turns", "p", "q"], "left_anti").select(*KEY, "turns")


def format_chats(turns: DataFrame, open_: str = OPEN, close: str = CLOSE, stride: int = STRIDE) -> DataFrame:
    """conv_id, turns (of the whole conversation), part (from 0), rendered; one row per `stride` turns of a kept conversation."""
    rows = placed(turns)
    first = materialize(starts(rows), "starts")
    keep = materialize(maximal(materialize(prefixes(rows, first), "prefixes")), "kept-chats")
    start, _, end = open_.partition("{role}")
    piece = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(end), F.coalesce("text", F.lit("")), F.lit(close))
    # A conversation of at most `stride` turns is part 0, wherever it stands; only the starts of longer ones are looked up.
    long_ = first.filter(F.col("turns") > stride).select(*KEY, "range", "low", "base")
    part = F.coalesce(F.floor((F.col("base") + F.col("k") - F.col("low")) / stride), F.lit(0)).cast("long")
    parted = small_join(rows.select("conv_id", *KEY, "range", "k", piece.alias("piece")), long_, [*KEY, "range"]).select("conv_id", *KEY, part.alias("part"), "range", "k", "piece")
    wanted = keep.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("turns") - 1) / stride).cast("long"))))
    runs = parted.join(wanted, [*KEY, "part"]).groupBy("conv_id", *KEY, "turns", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "k", "piece"))), lambda x: x["piece"]), "").alias("rendered"))
    return runs.select("conv_id", "turns", F.col("part").cast("int").alias("part"), "rendered")
