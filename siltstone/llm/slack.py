"""Packing by minimum bin slack.

Documents are cut into whole sequences and one rest. What decides the packing is only how many rests there are of each
length, at most `length - 1` numbers whatever the table's size. From them `plan` fills one window after another: the
longest rest that is left goes in first, a bitset subset-sum over the multiset of remaining lengths finds the fill closest
to the capacity, backtracking gives the counts, and the same window is repeated as often as the counts allow. Where even
the best fill leaves slack, the shortest remaining rest that is left is cut to close it and its other part goes back; the
last tokens, fewer than a sequence, become sequences of powers of two, which are never padded.

Every rest has a rank among those of its length: its number inside the task that wrote it plus the counts of the tasks
before. The plan is intervals of ranks, so each task places its rests by itself with a binary search. Texts don't move; a
cut rest fetches its ids from the table that the first pass wrote. Equal rows have different ranks, so none is special.

Edge cases: a null or empty text is the single end id; repeated rows are packed as often as they occur; null ids of
documents are allowed; very long texts are encoded in chunks; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch_path, ship, small_join
from .tokens import encoder, vocabulary_path

LENGTH = 1024
VOCABULARY = "byte_bpe_50k.json"

RESTS = "part int, n long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: A plan's row: rests of length `of` with ranks from `low` on, `many` of them, give their tokens from `skip` on, `size` of
#: them, to sequence `sequence + i // each` at `offset + i % each * size`, where i = `first` + rank - low.
FIELDS = ("of", "low", "many", "skip", "size", "sequence", "each", "first", "offset")


def fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to capacity of a multiset of lengths, and how many of each length make it (long ones first)."""
    mask, reach, steps = (2 << capacity) - 1, 1, []
    for size in sorted(counts):
        if size > capacity:
            break
        steps.append((size, reach))
        left, step = min(counts[size], capacity // size), 1
        while left > 0:
            step = min(step, left)
            reach |= reach << step * size & mask
            left -= step
            step *= 2
    best = left = reach.bit_length() - 1
    used = {}
    for size, before in reversed(steps):
        k = min(counts[size], left // size)
        while k and not before >> left - k * size & 1:
            k -= 1
        if k:
            used[size] = k
            left -= k * size
    return best, used


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[np.ndarray, int, int]:
    """counts: rests by length (below `length`). Rows of FIELDS, the number of sequences, and how many cuts are made."""
    left = {size: n for size, n in counts.items() if n}
    runs: dict[int, deque] = defaultdict(deque)
    for size, n in left.items():
        runs[size].append((size, 0, n, 0))
    rows: list[tuple] = []
    sequence = cuts = 0

    def take(size: int, n: int, each: int, offset: int, part: int | None = None) -> None:
        """n rests of a length go to the windows that begin at `sequence`; of cut ones, the first `part` tokens."""
        first = 0
        while first < n:
            of, low, many, skip = runs[size].popleft()
            now = min(many, n - first)
            if now < many:
                runs[size].appendleft((of, low + now, many - now, skip))
            rows.append((of, low, now, skip, part or size, sequence, each, first, offset))
            if part:
                runs[size - part].append((of, low, now, skip + part))
            first += now
        left[size] -= n
        if not left[size]:
            del left[size]
        if part:
            left[size - part] = left.get(size - part, 0) + n

    while sum(size * n for size, n in left.items()) >= length:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        best, used = fill({s: n for s, n in rest.items() if n}, length - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = length - longest - best
        need = dict(used)
        # All that the best fill leaves is longer than the slack: else it would have gone in.
        closing = min(s for s, n in left.items() if n > used.get(s, 0)) if slack else 0
        if slack:
            need[closing] = need.get(closing, 0) + 1
        times = min(left[s] // n for s, n in need.items() if n)
        offset = 0
        for size in sorted((s for s, n in used.items() if n), reverse=True):
            take(size, used[size] * times, used[size], offset)
            offset += used[size] * size
        if slack:
            take(closing, times, 1, offset, slack)
            cuts += times
        sequence += times

    todo = deque((of, low + i, skip, size) for size in sorted(left, reverse=True) for of, low, many, skip in runs[size] for i in range(many))
    total = sum(p[3] for p in todo)
    for bit in range(total.bit_length() - 1, -1, -1):
        offset, room = 0, total & 1 << bit
        while room:
            of, low, skip, size = todo.popleft()
            now = min(size, room)
            rows.append((of, low, 1, skip, now, sequence, 1, 0, offset))
            if now < size:
                todo.appendleft((of, low, skip + now, size - now))
                cuts += 1
            offset += now
            room -= now
        sequence += offset > 0
    return np.array(rows, np.int64).reshape(-1, len(FIELDS)), sequence, cuts


class Placing:
    """A plan as intervals of ranks: which of its rows hold for a rest of a length and a rank."""

    def __init__(self, rows: np.ndarray) -> None:
        points = np.unique(np.concatenate([self._key(rows[:, 0], rows[:, 1]), self._key(rows[:, 0], rows[:, 1] + rows[:, 2])]))
        a = np.searchsorted(points, self._key(rows[:, 0], rows[:, 1]))
        b = np.searchsorted(points, self._key(rows[:, 0], rows[:, 1] + rows[:, 2]))
        row = np.repeat(np.arange(len(rows)), b - a)
        at = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        order = np.lexsort((rows[row, 3], at))
        self.points, self.rows, self.held = points, rows, row[order]
        self.counts = np.bincount(at, minlength=len(points))
        self.begin = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _key(of: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return of << 48 | rank

    def __call__(self, of: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which rest each piece is of, and the piece's skip, size, sequence and offset."""
        at = np.searchsorted(self.points, self._key(of, rank), "right") - 1
        n = self.counts[at]
        rest = np.repeat(np.arange(len(of)), n)
        inside = np.arange(len(rest)) - np.repeat(np.cumsum(n) - n, n)
        f = dict(zip(FIELDS, self.rows[self.held[np.repeat(self.begin[at], n) + inside]].T))
        i = f["first"] + rank[rest] - f["low"]
        return rest, {"skip": f["skip"], "length": f["size"], "sequence_id": f["sequence"] + i // f["each"], "offset": f["offset"] + i % f["each"] * f["size"]}


def rests(documents: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Whole sequences and rests with their ids, written once; n numbers those of one length that one task wrote."""
    spark = documents.sparkSession
    ship(spark)
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or b"") + tail
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    size = len(piece) // 4
                    for col, v in zip(out, (part, seen[size], doc_id, at // 4, size, zlib.crc32(piece), len(ids) // 4, piece)):
                        col.append(v)
                    seen[size] += 1
            kinds = (pa.int32(), *[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in RESTS.split(", ")])

    path = scratch_path(spark, "rests")
    documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, RESTS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(RESTS).parquet(path)


def pack_documents(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    spark = documents.sparkSession
    pieces = rests(documents, vocabulary or vocabulary_path(VOCABULARY), length, end_id)
    counts = materialize(pieces.groupBy("part", "length").count(), "counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `length` rows
    whole = by_length.pop(length, 0)
    rows, sequences, cuts = plan(by_length, length)
    # Whole sequences come after the planned ones.
    rows = np.concatenate([rows, np.array([(length, 0, whole, 0, length, sequences, 1, 0, 0)] * bool(whole), np.int64).reshape(-1, len(FIELDS))])
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = small_join(pieces.drop("ids"), base, ["part", "length"], "inner").withColumn("rank", F.col("base") + F.col("n")).drop("base")
    placing = Placing(rows) if len(rows) else None
    names = ["part", "n", "of", "skip", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            of = c["length"].to_numpy(zero_copy_only=False)
            rest, f = placing(of, c["rank"].to_numpy(zero_copy_only=False))
            take = lambda name: c[name].take(pa.array(rest))
            cut = f["length"] < of[rest]
            start = c["start"].to_numpy(zero_copy_only=False)[rest] + f["skip"]
            crc = pa.array(take("ids_crc32").to_numpy(zero_copy_only=False), pa.int64(), mask=cut)
            cols = [take("part"), take("n"), pa.array(of[rest]), pa.array(f["skip"]), take("doc_id"), pa.array(start), pa.array(f["length"]), crc, take("doc_tokens"), pa.array(f["sequence_id"]), pa.array(f["offset"])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    placed = ranked.mapInArrow(run, "part int, n long, of long, skip long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    if not keep_ids and not cuts:
        return placed.select(*out)
    placed = materialize(placed, "placed")
    fetch = placed if keep_ids else placed.filter("ids_crc32 IS NULL")
    source = pieces.select("part", "n", F.col("length").alias("of"), F.col("ids").alias("_ids"))
    if not keep_ids:  # only lengths that are cut have to be looked at: at most `length`
        source = source.filter(F.col("of").isin(sorted({int(r[0]) for r in rows if r[4] < r[0]})))
    fetched = small_join(source, fetch, ["part", "n", "of"], "inner").withColumn("ids", F.expr("substring(_ids, CAST(4 * skip + 1 AS INT), CAST(4 * length AS INT))"))
    fetched = fetched.withColumn("ids_crc32", F.crc32("ids")).select(*out)
    return fetched if keep_ids else placed.filter("ids_crc32 IS NOT NULL").select(*out).unionByName(fetched)
