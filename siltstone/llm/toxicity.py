"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Presence of hashed n-grams (within words, with word ends) is counted per label over the training rows; the log-count
ratio of each bucket scales its feature. Logistic regression with an L2 penalty then weighs the scaled features of the
most telling buckets. Scoring is one pass over whole texts with one table lookup per n-gram.

Bounds (parameters): at most `sample` training rows per label, chosen by hash of the id; 2**BITS buckets; FEATURES
features. The rows that go to the driver are one bitmap of FEATURES bits for each training row, 1 KB each.

Edge cases: null and empty texts get the model's bias, a score like any other; a null doc_id in labels matches nothing;
an id with several labels counts once per distinct label; repeated documents are scored alike; with no training rows of
one label every score is that of the prior; an empty table gives an empty result; other columns pass through, but for
one named like the result, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_PARTS, add_columns, crc_bucket, drop_scratch, materialize, plain, ship
from .ngrams import code_points, groups, hashed

SIZES = range(3, 7)
BITS = 20
FEATURES = 8192
SAMPLE = 10_000
MIN_ROWS = 3
#: A telling bucket's rows are so many times (e to this power) as frequent under one label; this also keeps rows sparse.
MIN_RATIO = 1.0
PENALTY = 1e-3


def present(texts: list[str | None], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket or, with a table, slot) of the texts' n-grams; slot -1 of the table is dropped."""
    keys = []
    for index, parts in groups(texts):
        cp, part = code_points(parts)
        of = np.array(index, np.int64)
        mine = []
        for at, bucket in hashed(cp, SIZES, BITS):
            if table is not None:
                slot = table[bucket]
                hit = np.flatnonzero(slot >= 0)
                at, bucket = at[hit], slot[hit]
            mine.append(of[part[at + 1]] << BITS | bucket.astype(np.int64))
        keys.append(np.unique(np.concatenate(mine)))
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def training_rows(documents: DataFrame, labels: DataFrame, label: str, sample: int, seed: int = 17) -> DataFrame:
    """text and y of at most about `sample` rows per label outside fold 0, by hash of the id."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(f"doc_id IS NOT NULL AND {label} IN (0, 1)").distinct().filter(crc_bucket(F.col("doc_id")) != 0)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, int(min(1.0, sample / n) * (1 << 30))).otherwise(share)
    chosen = known.filter(draw < share)
    # At most a sample of ids: their size is bounded by the parameter.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


def _counts(batches):
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        texts, y = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
        for a in range(0, len(texts), 500):
            row, bucket = present(texts[a : a + 500])
            one = y[a : a + 500][row] == 1
            pos += np.bincount(bucket[one], minlength=1 << BITS).astype(np.int32)
            neg += np.bincount(bucket[~one], minlength=1 << BITS).astype(np.int32)
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at].astype(np.int64)), pa.array(neg[at].astype(np.int64))], names=["bucket", "p", "q"])


def _bitmaps(table: np.ndarray, features: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 500):
                row, slot = present(texts[a : a + 500], table)
                bits = np.zeros((len(texts[a : a + 500]), features), bool)
                bits[row, slot] = True
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()), batch.column(1)[a : a + 500]], names=["bits", "y"])

    return run


def minimize(f, x: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; f gives (value, gradient)."""
    value, grad = f(x)
    s_, y_ = [], []
    for _ in range(steps):
        d, a_ = -grad, []
        for s, y in zip(reversed(s_), reversed(y_)):
            a = (s @ d) / (s @ y)
            a_.append(a)
            d = d - a * y
        if s_:
            d = d * ((s_[-1] @ y_[-1]) / (y_[-1] @ y_[-1]))
        for (s, y), a in zip(zip(s_, y_), reversed(a_)):
            d = d + (a - (y @ d) / (s @ y)) * s
        t = 1.0 if s_ else 1.0 / max(1.0, float(np.abs(grad).sum()))
        slope = grad @ d
        for _ in range(30):
            new, new_grad = f(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_grad - grad
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, new, new_grad
        if s @ y > 1e-12:
            s_, y_ = [*s_[1 - memory :], s], [*y_[1 - memory :], y]
        if done:
            break
    return x


class Model:
    """table: bucket to slot (or -1); weight by slot; bias."""

    def __init__(self, table: np.ndarray, weight: np.ndarray, bias: float) -> None:
        self.table, self.weight, self.bias = table, weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.weight):
            row, slot = present(texts, self.table)
            z += np.bincount(row, self.weight[slot], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY) -> Model:
    ship(documents.sparkSession)
    # The scan is as wide as the corpus; only the bounded sample is dealt to few tasks, and read from there.
    rows = materialize(training_rows(documents, labels, label, sample).repartition(SAMPLE_PARTS), "toxicity-sample")
    counted = rows.mapInArrow(_counts, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    np_, nq = n.get(1, 0), n.get(0, 0)
    table = np.full(1 << BITS, -1, np.int32)
    if not np_ or not nq:
        return Model(table, np.zeros(0), float(np.log((np_ + 1) / (nq + 1))))
    ratio = F.log((F.col("p") + 1) / (np_ + 2)) - F.log((F.col("q") + 1) / (nq + 2))
    telling = counted.filter(F.col("p") + F.col("q") >= MIN_ROWS).withColumn("r", ratio).withColumn("z", F.abs(F.col("r")) - F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))).filter(F.abs("r") >= MIN_RATIO)
    best = telling.orderBy(F.desc("z"), "bucket").limit(features).select("bucket", "r").collect()
    r = np.array([b["r"] for b in best])
    table[[b["bucket"] for b in best]] = np.arange(len(best))
    got = rows.mapInArrow(_bitmaps(table, features), "bits binary, y int").toArrow()
    drop_scratch(rows)
    # In an order of their own, so that sums do not depend on the order in which tasks end.
    rows_ = sorted(zip(got["bits"].to_pylist(), got["y"].to_pylist()))
    y = np.array([k for _, k in rows_], float)
    at, col = [], []
    for i, (b, _) in enumerate(rows_):
        on = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))
        at.append(np.full(len(on), i, np.int32))
        col.append(on.astype(np.int32))
    at, col = np.concatenate(at), np.concatenate(col)
    val = r[col].astype(np.float32)
    del got, rows_
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh the same

    def loss(w):
        z = np.bincount(at, val * w[:-1][col], len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = share * (p - y)
        v = (share * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w[:-1] @ w[:-1])
        return v, np.append(np.bincount(col, g[at] * val, len(r)) + penalty * w[:-1], g.sum())

    w = minimize(loss, np.zeros(len(r) + 1))
    return Model(table, w[:-1] * r, float(w[-1]))


def score(documents: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """documents plus `column`, the probability of the label."""
    spark, documents = documents.sparkSession, documents.select(*plain([c for c in documents.columns if c.lower() != column.lower()]))
    ship(spark)
    shared = spark.sparkContext.broadcast((model.table, model.weight, model.bias))  # 4 MB by construction
    where = documents.columns.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                b = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(b.column(where).to_pylist()))], names=[*b.schema.names, column])

    return documents.mapInArrow(run, add_columns(documents.schema, T.StructField(column, T.DoubleType())))
