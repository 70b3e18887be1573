"""Document fingerprints by order MinHash, in DataFrame functions only.

A text's k-mers are K words in a row (words: runs of characters other than white space), numbered by occurrence. Hashes
of (k-mer, occurrence) part them into BINS bins; of each bin the TUPLE smallest are selected, put back into text order
and hashed as a tuple. The tuples are the fingerprint: they change when words change, and when they change places. Bins
of short texts may be empty; likeness is the share of equal tuples among the bins that either fingerprint fills.

All work is per row, in arrays of longs: a k-mer is a hash's upper 40 bits with its place in the lower 24, so one plain
sort numbers occurrences and another selects. A text of more than 2**24 words is numbered in places modulo 2**24.

Edge cases: a null text is empty; texts without words have an empty fingerprint, and two empty fingerprints have
likeness 1; with fewer than K words the whole is one k-mer, which is also all that a text without white space has; equal
texts have equal fingerprints; rows that repeat a doc_id are neighbours, in the order of a hash; a null doc_id comes
first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 2
TUPLE = 2
#: A power of two; BIN_BITS of it.
BINS, BIN_BITS = 64, 6
PLACE = (1 << 24) - 1
#: Rows of a range, about, and quantiles that the driver gets at most.
RANGE_ROWS = 32_768
TOPS = 256
WORD = r"[^\s]+"


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, size: int = TUPLE) -> DataFrame:
    """df plus `out`, an array of longs: bin number, then 32 bits of the bin's tuple."""
    words, grams, runs, numbered, chosen = (f"_{out}_{x}" for x in ("words", "grams", "runs", "numbered", "chosen"))
    df = df.withColumn(words, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    more = "".join(f", get({words}, i + {j})" for j in range(1, k))
    df = df.withColumn(grams, F.expr(f"array_sort(transform(slice({words}, 1, greatest(size({words}) - {k - 1}, least(size({words}), 1))), (w, i) -> (xxhash64(w{more}) & {~PLACE}) | (i & {PLACE})))"))
    # Where runs of the same k-mer start; its places inside a run are its occurrences, in text order.
    df = df.withColumn(runs, F.expr(f"filter(transform({grams}, (g, i) -> IF(i > 0 AND shiftright(g, 24) = shiftright(get({grams}, i - 1), 24), -1, i)), i -> i >= 0)"))
    df = df.withColumn(numbered, F.expr(f"array_sort(flatten(transform({runs}, (s, j) -> transform(slice({grams}, s + 1, coalesce(get({runs}, j + 1), size({grams})) - s), (g, o) -> (xxhash64(shiftright(g, 24), o) & {~PLACE}) | (g & {PLACE})))))"))
    bin_ = lambda x: f"shiftrightunsigned({x}, {64 - BIN_BITS})"
    # The first of each bin, then bin, place and 34 bits of the k-mer's hash in one long, to sort by text order.
    df = df.withColumn(chosen, F.expr(f"array_sort(transform(filter({numbered}, (x, i) -> i < {size} OR {bin_('x')} <> {bin_(f'get({numbered}, i - {size})')}), x -> shiftleft({bin_('x')}, 58) | shiftleft(x & {PLACE}, 34) | (shiftrightunsigned(x, 24) & {(1 << 34) - 1})))"))
    rest = "".join(f", IF({bin_(f'get({chosen}, i + {j})')} = {bin_('x')}, get({chosen}, i + {j}) & {(1 << 34) - 1}, NULL)" for j in range(1, size))
    df = df.withColumn(out, F.expr(f"filter(transform({chosen}, (x, i) -> IF(i > 0 AND {bin_(f'get({chosen}, i - 1)')} = {bin_('x')}, -1L, shiftleft({bin_('x')}, 32) | (xxhash64(x & {(1 << 34) - 1}{rest}) & {0xFFFFFFFF}))), x -> x >= 0)"))
    return df.drop(words, grams, runs, numbered, chosen)


def rendered(fp: str) -> Column:
    """Ten hex digits per filled bin: bin number and tuple."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the bins that either fills; 1 for two empty ones."""
    bins = F.size(F.expr(f"array_union(transform({a}, x -> shiftright(x, 32)), transform({b}, x -> shiftright(x, 32)))"))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _pick(bounds: list, lo: int, hi: int, id_: str) -> Column:
    """Number of bounds at or below the id, as a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col(id_) >= bounds[mid], _pick(bounds, mid + 1, hi, id_)).otherwise(_pick(bounds, lo, mid, id_))


def _ranges(documents: DataFrame, id_: str, order: Column, buckets: int | None) -> tuple[Column, int]:
    """The number of each row's range, ascending with (id, order), and how many ranges there are about.

    Bounds are quantiles of the ids, with ranges of equal width between them. An id that more rows share than a quantile
    holds (null is an id too) has ranges of its own, by `order`, which is spread evenly over all longs.
    """
    spark = documents.sparkSession
    rows = documents.count()
    wanted = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    tops = min(wanted, TOPS)
    cuts = documents.approxQuantile(id_, [i / tops for i in range(1, tops)], 0.25 / tops) if tops > 1 else []
    # At most TOPS ids can have so many rows.
    least = max(rows // TOPS, 2 * rows // wanted, 1)
    hot = {r[id_]: r["count"] for r in documents.groupBy(id_).count().filter(F.col("count") > least).collect()}
    bounds = sorted(b for b in {int(c) for c in cuts} | {b for h in hot if h is not None for b in (h, h + 1)} if -(1 << 63) <= b < 1 << 63)
    fine = -(-wanted // tops)
    own = {h: max(1, min(wanted, -(-n * wanted // rows))) for h, n in hot.items()}
    most = max([fine, *own.values()])
    number = _pick(bounds, 0, len(bounds), id_)
    inside = F.lit(0)
    if fine > 1 and bounds:
        low = F.element_at(F.array(*[F.lit(x) for x in [bounds[0], *bounds]]), (number + 1).cast("int"))
        high = F.element_at(F.array(*[F.lit(x) for x in [*bounds, bounds[-1]]]), (number + 1).cast("int"))
        inside = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((F.col(id_).cast("double") - low.cast("double")) * fine / F.greatest(F.lit(1.0), high.cast("double") - low.cast("double")))))
    share = lambda n: F.floor(F.shiftrightunsigned(F.shiftright(order, 1) + F.lit(1 << 62), 32) * n / float(1 << 31))
    for h, n in own.items():
        inside = F.when(F.col(id_).eqNullSafe(F.lit(h)), F.least(F.lit(n - 1), share(n))).otherwise(inside)
    return F.when(F.isnull(id_), -1).otherwise(number) * most + F.coalesce(inside.cast("long"), F.lit(0)), wanted


def with_next(documents: DataFrame, columns: list[str], id_: str = "doc_id", text: str = "text", buckets: int | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """documents plus next_<column> from the row that follows in ascending id; the last row's is the first's. Rows that share
    an id follow each other in the order of a hash of their text and place.

    prepare adds columns that are to be sent along; it runs once on each row.

    Ranges of ids are dealt out once. The first row of each range is also sent to the range before it, so nothing but
    range bounds and one row number per range goes through the driver.
    """
    spark = documents.sparkSession
    # Equal rows differ by the input partition they stand in, so that a group of them is spread as well.
    placed = documents.withColumn("_order", F.xxhash64(F.col(text), F.spark_partition_id())).withColumn("_row", F.monotonically_increasing_id())
    number, parts = _ranges(documents, id_, F.col("_order"), buckets)
    keyed = placed.withColumn("_bucket", number.cast("long")).withColumn("_ghost", F.lit(0))
    key = [F.isnotnull(id_).alias("some"), F.col(id_).alias("id"), F.col("_order").alias("order"), F.col("_row").alias("row")]
    firsts = sorted((r["_bucket"], r["row"]) for r in keyed.groupBy("_bucket").agg(F.min(F.struct(*key)).alias("head")).select("_bucket", "head.row").collect())
    if not firsts:
        return prepare(documents).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    sent = spark.createDataFrame([(row, firsts[i - 1][0]) for i, (_, row) in enumerate(firsts)], "_row long, _to long")
    # One row per range: the broadcast has as many as there are ranges.
    ghosts = keyed.join(F.broadcast(sent), "_row").withColumn("_bucket", F.col("_to")).withColumn("_ghost", F.lit(1)).drop("_to")
    w = W.partitionBy("_bucket").orderBy("_ghost", F.col(id_).asc_nulls_first(), "_order", "_row")
    out = prepare(keyed.unionByName(ghosts)).repartition(parts, "_bucket")
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.filter("_ghost = 0").drop("_bucket", "_ghost", "_order", "_row")


def fingerprints(documents: DataFrame, k: int = K, size: int = TUPLE) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike they and the next document's are.

    The edited text: the last half of the code points (rounded down) replaced by as many of the next document's first.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "fp"], prepare=lambda df: with_fingerprint(df, "text", "fp", k, size))
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    docs = docs.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - _half)"), F.expr("left(next_text, _half)"))).drop("text", "next_text", "_half")
    return with_fingerprint(docs, "edited", "edited_fp", k, size)


def digest_rows(documents: DataFrame) -> DataFrame:
    return fingerprints(documents).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        rendered("fp").alias("fingerprint"),
        rendered("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
