"""Language identification of mixed-language text.

Each word is scored for each language by hashed character n-grams (with word ends); the script of its first letter
narrows the candidates to the languages that were seen in that script. Viterbi then labels the words of a text with a
penalty for each switch of language: runs of one label are spans. A text's language is the one with most words.

Viterbi runs over all texts of a batch in lockstep. Neighbouring words that favour the same language are joined first,
which changes no best path: inside such a run no other language can gain by starting late or ending early.

Bounds (parameters): at most about `sample` training texts per language, chosen by hash of the id; 2**BITS buckets by
the learned languages in the model, and fewer buckets where these would be more than TABLE numbers (beyond 64 languages).

Edge cases: a null text or one without letters is `und` with score 0 and no spans; ties go to the language that comes
first by name; null languages are not learned; repeated rows get the same answer; with nothing to learn from every text
is `und`; an empty table gives an empty result; other columns pass through, but for those named like a result, which
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_PARTS, add_columns, drop_scratch, materialize, plain, ship, small_join
from .ngrams import Counts, code_points, groups, hashed

SIZES = range(2, 5)
BITS = 18
#: Numbers of a model: buckets times languages, at most (4 bytes each).
TABLE = 1 << 24
SAMPLE = 4_000
#: What a switch of language costs, in nats; n-grams of a word overlap, so their scores are scaled down.
SWITCH = 9.0
SCALE = 0.5
#: A language is a candidate for a script that has at least this share of its training letters.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

#: First code points of the scripts told apart (fixed values): Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic,
#: Devanagari, other Indic, Thai, other, Georgian, Hangul, other, Latin, Greek, other, Kana, other, Han, other, Hangul, other.
SCRIPT_FROM = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0])
SCRIPT_ID = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 9, 10, 12, 0, 1, 12, 11, 12, 13, 12, 10, 12])
SCRIPTS = 14


def _scripts(cp: np.ndarray) -> np.ndarray:
    return SCRIPT_ID[np.searchsorted(SCRIPT_FROM, cp, side="right") - 1]


def bits_for(languages: int) -> int:
    return max(8, min(BITS, (TABLE // max(1, languages)).bit_length() - 1))


def _counts(languages: list[str], bits: int):
    """(text, lang) to (bucket, lang, n); buckets from 2**bits on count the scripts of letters."""
    number = {x: i for i, x in enumerate(languages)}

    def row(got):
        key, n = got
        return pa.RecordBatch.from_arrays([pa.array((key // len(number)).astype(np.int32)), pa.array((key % len(number)).astype(np.int32)), pa.array(n)], names=["bucket", "lang", "n"])

    def run(batches):
        n, counts = len(number), Counts()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for index, parts in groups(texts):
                cp, part = code_points(parts)
                lang = langs[np.array(index)][part]
                for at, bucket in hashed(cp, SIZES, bits):
                    counts.add(bucket.astype(np.int64) * n + lang[at + 1])
                at = np.flatnonzero(cp)
                counts.add(((1 << bits) + _scripts(cp[at])) * n + lang[at])
                if got := counts.full():
                    yield row(got)
        if got := counts.rest():
            yield row(got)

    return run


def fit(documents: DataFrame, train: Column, sample: int = SAMPLE, seed: int = 23) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-odds by (bucket, language), and which languages a script may be."""
    ship(documents.sparkSession)
    known = documents.filter(train & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, 0), np.float32), np.zeros((SCRIPTS, 0), bool)
    bits, draw = bits_for(len(languages)), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    shares = documents.sparkSession.createDataFrame([(x, int(min(1.0, sample / n) * (1 << 30))) for x, n in counts.items()], "lang string, _share long")
    # The scan is as wide as the corpus; only the bounded sample is dealt to few tasks, and read from there.
    drawn = small_join(known.select("doc_id", "text", "lang"), shares, ["lang"], "inner").filter(draw < F.col("_share"))
    rows = materialize(drawn.select("text", "lang").repartition(SAMPLE_PARTS), "language-sample")
    got = rows.mapInArrow(_counts(languages, bits), "bucket int, lang int, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow()
    drop_scratch(rows)
    table = np.zeros(((1 << bits) + SCRIPTS, len(languages)))
    table[got["bucket"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = table[: 1 << bits], table[1 << bits :]
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    odds = np.log(grams + 0.5) - np.log(grams.sum(0) + 0.5 * max(1, (grams.sum(1) > 0).sum()))
    odds -= odds.mean(1, keepdims=True)
    odds[grams.sum(1) == 0] = 0
    return languages, (SCALE * odds).astype(np.float32), allowed


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row; starts: where each text's rows start (every text has one at least)."""
    n, width = scores.shape
    favour = scores.argmax(1)
    edge = np.ones(n, bool)
    edge[1:] = favour[1:] != favour[:-1]
    edge[starts] = True
    runs = np.flatnonzero(edge)
    score = np.add.reduceat(scores, runs, axis=0)
    first = np.searchsorted(runs, starts)
    count = np.diff(np.append(first, len(runs)))
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = len(count) - np.searchsorted(count[::-1], np.arange(count[0]), side="right")  # texts with more than t runs
    best = score[first].astype(np.float64)
    moved = np.zeros((len(runs), width), bool)
    came = np.zeros(len(runs), np.int32)
    for t in range(1, int(count[0])):
        k = alive[t]
        at = first[:k] + t
        old = best[:k]
        top = old.max(1, keepdims=True) - switch
        came[at] = old.argmax(1)
        moved[at] = old < top
        best[:k] = np.maximum(old, top) + score[at]
    label = np.zeros(len(runs), np.int32)
    now = best.argmax(1).astype(np.int32)
    for t in range(int(count[0]) - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(moved[at, now[:k]], came[at], now[:k])
    return np.repeat(label, np.diff(np.append(runs, n)))


def word_scores(texts: list[str | None], odds: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, score by language) of every word, in order; languages that the word's script rules out are far below."""
    width, of, scores = odds.shape[1], [], []
    bits = len(odds).bit_length() - 1
    for index, parts in groups(texts):
        cp, part = code_points(parts)
        start = np.flatnonzero((cp[1:] != 0) & (cp[:-1] == 0)) + 1
        if not len(start):
            continue
        word = np.cumsum(np.bincount(start, minlength=len(cp))) - 1
        total = np.zeros((len(start), width), np.float32)
        for at, bucket in hashed(cp, SIZES, bits):
            mine = word[at + (cp[at] == 0)]
            if len(at):
                cut = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                total[mine[cut]] += np.add.reduceat(odds[bucket], cut, axis=0)
        total -= np.where(allowed[_scripts(cp[start])], 0, 1e3).astype(np.float32)
        of.append(np.array(index)[part[start]])
        scores.append(total)
    if not of:
        return np.zeros(0, np.int64), np.zeros((0, width), np.float32)
    return np.concatenate(of), np.concatenate(scores)


def label_words(texts: list[str | None], odds: np.ndarray, allowed: np.ndarray, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, language) of every word, in order."""
    of, scores = word_scores(texts, odds, allowed)
    if not len(of):
        return of, np.zeros(0, np.int32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return of, viterbi(scores, starts, switch)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("words", T.IntegerType())]))


RESULTS = ("lang_pred", "lang_score", "lang_spans")


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], switch: float = SWITCH, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """documents plus, by these names, the language, the share of words in it and, if a third is given, the spans."""
    spans = len(results) > 2
    gone = {r.lower() for r in results}
    spark, documents = documents.sparkSession, documents.select(*plain([c for c in documents.columns if c.lower() not in gone]))
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most TABLE floats
    where = documents.columns.index("text")

    def run(batches):
        languages, odds, allowed = shared.value
        width = len(languages)
        span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                n = batch.num_rows
                of, lang = label_words(batch.column(where).to_pylist(), odds, allowed, switch) if width else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                words = np.bincount(of * max(1, width) + lang, minlength=n * max(1, width)).reshape(n, -1)
                top, total = words.argmax(1), words.sum(1)
                pred = [languages[k] if t else UNKNOWN for k, t in zip(top.tolist(), total.tolist())]
                out = [*batch.columns, pa.array(pred), pa.array(words[np.arange(n), top] / np.maximum(total, 1))]
                if spans:
                    cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (lang[1:] != lang[:-1]))) if len(of) else np.zeros(0, np.int64)
                    begin = np.searchsorted(of, np.arange(n))
                    size = np.diff(np.append(cut, len(of)))
                    flat = pa.StructArray.from_arrays([pa.array([languages[k] for k in lang[cut].tolist()], pa.string()), pa.array((cut - begin[of[cut]]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["lang", "first_word", "words"])
                    out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of[cut], np.arange(n + 1)).astype(np.int32)), flat).cast(span_type))
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *results])

    types = [T.StringType(), T.DoubleType(), SPANS]
    return documents.mapInArrow(run, add_columns(documents.schema, *map(T.StructField, results, types)))
