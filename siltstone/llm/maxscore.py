"""Exact top-k search by inner product with MaxScore.

A vector's terms are its dimensions with whole-number weights; a shard keeps one posting column per dimension and the
least and greatest weight in it. For a query these give each term's bounds. Terms are taken by the width of their
bounds: the weakest terms, which even together can't lift a vector above the k-th score known so far, are
non-essential. Essential postings are traversed for the whole shard; then the others are probed only for vectors whose
score so far plus the bounds of what is left is still competitive. Shards' best rows merge by window.

Every query starts with the k-th best score among a bounded sample of all rows, so a shard returns only what can still be
among the best, and a shard whose bounds stay below is left at once. Shards and query blocks have fixed sizes, so a task
holds one shard's columns and one block's queries (widened SLICE at a time), and the queries are never broadcast as a whole;
a vector is copied once for BLOCK queries. Weights travel as the smallest whole-number type that holds them all.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a
shorter vector lacks the terms beyond its end (weight 0); rows that repeat an id are candidates one by one, and of a
repeated query id one row asks; a query without any candidate returns no row, so does an empty table; other columns are
not read. A weight beyond 64 bits counts as the greatest or the least 64-bit number. Sums are exact; where they may pass
64 bits, a shard is scored in whole numbers of any size, and a score beyond counts as the greatest or the least one, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship

SCALE = 64
SHARD = 16_384
BLOCK, SLICE = 100_000, 4_096
#: Rows of the sample that every query's first threshold comes from, about.
SEED_ROWS = 4_096
PROBE = 4


def weights(vectors: DataFrame, id_: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and w, the floored whole-number weights, of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(id_).isNotNull() & F.col(vector).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(fine).select(F.col(id_).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("w"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows by width; missing terms are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _most(w: np.ndarray) -> int:
    """The greatest absolute weight, without the least number's overflow."""
    return max(int(w.max(initial=0)), -int(w.min(initial=0)))


class Shard:
    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.rows = np.ascontiguousarray(rows[order])
        self.low, self.high = self.rows.min(0), self.rows.max(0)
        self.most = most = _most(self.rows)
        self.columns = np.ascontiguousarray(self.rows.T.astype(np.int32 if most < 1 << 15 else np.int64))

    def search(self, own: int, q: np.ndarray, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k (ties to smaller ids), without rows of id `own`. known: a k-th score of some rows."""
        if self.most * _most(q) * max(1, len(q)) >= 1 << 62:
            return self._search_wide(own, q, k)
        lo, hi = np.minimum(q * self.low, q * self.high), np.maximum(q * self.low, q * self.high)
        width = hi - lo
        order = np.argsort(-width, kind="stable")
        spare = np.append(np.cumsum(width[order][::-1])[::-1], 0)  # what terms from here on can add to their floors
        floor = int(lo.sum())
        if known is not None and int(hi.sum()) < known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Floors are part of every score, so only what terms add above them counts against the threshold.
        need = -(1 << 62) if known is None else known - floor
        essential = int(np.searchsorted(-spare, -need, side="right")) if need > 0 else len(q)
        essential = min(max(essential, 0), len(q))
        total = np.zeros(len(self.ids), self.columns.dtype if self.most * int(np.abs(q).max(initial=0)) * max(1, len(q)) < 1 << 31 else np.int64)
        for d in order[:essential].tolist():
            if q[d]:
                total += self.columns[d] * total.dtype.type(q[d])
        left = lambda n: int(hi[order[n:]].sum())
        if known is not None and len(total) > 4 * k:
            # The best so far, scored in full, may lift the threshold before the others are probed.
            near = np.argpartition(total, len(total) - 2 * k)[-2 * k :]
            near = near[self.ids[near] != own]
            if len(near) >= k:
                known = max(known, int(np.partition(self.rows[near] @ q, len(near) - k)[len(near) - k]))
        alive = np.flatnonzero(total + left(essential) >= known) if known is not None else np.arange(len(total))
        alive = alive[self.ids[alive] != own]
        score = total[alive].astype(np.int64)
        at = essential
        while at < len(order) and len(alive):
            for d in order[at : at + PROBE].tolist():
                if q[d]:
                    score += self.columns[d][alive].astype(np.int64) * int(q[d])
            at = min(at + PROBE, len(order))
            if known is not None:
                keep = score + left(at) >= known
                alive, score = alive[keep], score[keep]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


    def _search_wide(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same where sums may pass 64 bits."""
        alive = np.flatnonzero(self.ids != own)
        total = np.zeros(len(alive), object)
        for d in np.flatnonzero(q).tolist():
            total += self.columns[d][alive].astype(object) * int(q[d])
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in total.tolist()], np.int64)
        best = np.lexsort((self.ids[alive], ~score))[:k]  # ~ turns the order without overflow
        return self.ids[alive][best], score[best]


def thresholds(own: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[int | None]:
    """For each query the k-th best score among the rows of other ids, if there are k."""
    reach = _most(rows) * _most(q) * q.shape[1]
    if len(ids) <= k or reach >= 1 << 62:
        return [None] * len(q)
    if reach < 1 << 24:  # exact in 32-bit floats
        scores = (q.astype(np.float32) @ rows.T.astype(np.float32)).astype(np.int64)
    else:
        scores = q @ rows.T
    none = np.iinfo(np.int64).min
    scores[own[:, None] == ids[None, :]] = none
    kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return [None if x == none else int(x) for x in kth.tolist()]


def _width(*columns: pa.ChunkedArray | pa.Array) -> int:
    return max(1, *(int(pc.max(pc.list_value_length(c)).as_py() or 0) for c in columns))


def _seeded(shared, k: int):
    """(id, w) of queries plus known, a score that k rows reach."""

    def run(batches):
        sample = shared.value
        ids = sample["id"].to_numpy()
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                width = _width(batch.column(1), sample["w"])
                known = thresholds(batch.column(0).to_numpy(), _matrix(batch.column(1), width), ids, _matrix(sample["w"], width), k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known, pa.int64())], names=["id", "w", "known"])

    return run


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            width = _width(left["w"], right["w"])
            shard = Shard(left["id"].to_numpy(), _matrix(left["w"], width))
            for a in range(0, right.num_rows, SLICE):
                part = right.slice(a, SLICE)
                own, q = part["id"].to_numpy(), _matrix(part["w"], width)
                for i, known in enumerate(part["known"].to_pylist()):
                    ids, scores = shard.search(int(own[i]), q[i], k, known)
                    out[0].append(np.full(len(ids), own[i], np.int64))
                    out[1].append(ids)
                    out[2].append(scores)
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2].astype(np.int64)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = weights(vectors, id_, vector, scale)
    size = rows.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("w"), -1 - F.array_min("w"))).alias("most")).first()
    n, most = size["n"], size["most"] or 0
    kind = f"array<{'tinyint' if most < 1 << 7 else 'smallint' if most < 1 << 15 else 'int' if most < 1 << 31 else 'long'}>"
    rows = rows.withColumn("w", F.col("w").cast(kind))
    ask = weights(vectors.filter(is_query), id_, vector, scale).groupBy("id").agg(F.min("w").cast(kind).alias("w"))
    m = ask.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    # The sample is bounded by its parameter, whatever the number of rows.
    some = int(min(1.0, SEED_ROWS / max(1, n)) * (1 << 30))
    shared = spark.sparkContext.broadcast(rows.filter(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 30)) < some).toArrow().combine_chunks())
    asked = ask.mapInArrow(_seeded(shared, k), f"id long, w {kind}, known long")
    left = rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
