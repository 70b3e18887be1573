"""Best-fit packing of token sequences with bounded space.

Documents longer than a sequence are cut into whole sequences and one rest; every piece shorter than a sequence goes to
an open bin. A fixed number of bins is open. A bitset keyed by free space finds the open bin that a piece fits best; when
none fits and no bin may be opened, the fullest closes. What is still open at the end of a task's stream is packed once
more with the same number of open bins, longest pieces first.

Only piece lengths are dealt out: by hash of the piece, so every task sees a random order (which best fit likes) and no
source or group of copies meets in one task; equal rows (same id and text) have hashes of their own, by the task and batch
that read them. A task takes `tokens_per_task` tokens whatever the input's size, so the few
half-full bins at its end are a constant small share.

Edge cases: a null or empty text is the single end id; repeated rows are packed as often as they occur; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .tokens import encoder, vocabulary_path

LENGTH = 2048
OPEN_BINS = 2048
TOKENS_PER_TASK = 16_000_000
PIECES_PER_TASK = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


class OpenBins:
    """Open bins by free space; bit f of `mask` is set while some bin has f free."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.mask, self.count = 0, 0
        self.bins: list[list] = [[] for _ in range(length + 1)]

    def _take(self, free: int):
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.mask ^= 1 << free
        self.count -= 1
        return bin_

    def _put(self, free: int, bin_) -> None:
        if not self.bins[free]:
            self.mask |= 1 << free
        self.bins[free].append(bin_)
        self.count += 1

    def add(self, size: int, item, closed: list) -> None:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.most:
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, bin_ = self.length, []
        bin_.append((size, item))
        if free == size:
            closed.append(bin_)
        else:
            self._put(free - size, bin_)

    def rest(self) -> list:
        return [b for level in self.bins for b in level]


def pack_stream(pieces, length: int = LENGTH, most: int = OPEN_BINS) -> Iterator[list]:
    """pieces: (size, item), size from 1 to length. Yields bins as lists of them, in filling order."""
    closed: list = []
    open_ = OpenBins(length, most)
    for size, item in pieces:
        open_.add(size, item, closed)
        yield from closed
        closed.clear()
    again = OpenBins(length, most)
    for size, item in sorted((p for b in open_.rest() for p in b), key=lambda p: -p[0]):
        again.add(size, item, closed)
        yield from closed
        closed.clear()
    yield from again.rest()


def cut(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, copy and, if asked for, ids (little-endian 32-bit).

    copy tells equal rows apart: by the task and batch that read them, and their number there.
    """
    ship(documents.sparkSession)
    path, tail = vocabulary or vocabulary_path(), end_id.to_bytes(4, "little")

    def run(batches):
        enc, task = encoder(path), TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            out: tuple = ([], [], [], [], [], [], [])
            seen: dict = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py() or b"") + tail
                copy = 0
                for n, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    crc = zlib.crc32(part)
                    if not n:
                        again = seen[doc_id, crc] = seen.get((doc_id, crc), -1) + 1
                        copy = (task << 20 | number) << 20 | again
                    for col, v in zip(out, (doc_id, n, at // 4, len(part) // 4, crc, copy, part)):
                        if col is not out[6] or keep_ids:
                            col.append(v)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:6])]
            if keep_ids:
                arrays.append(pa.array(out[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "copy", "ids"][: len(arrays)])

    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32 and, to spread equal rows, copy) plus sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    pieces = materialize(pieces, "pieces")
    total, rows_ = pieces.filter(F.col("length") < length).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-total // tokens_per_task), -(-rows_ // PIECES_PER_TASK))
    # sequence ids: task number, then a running number in the task; whole sequences get odd numbers of their own.
    keyed = pieces.withColumn("_h", F.xxhash64("doc_id", "piece", "ids_crc32", *[c for c in ("copy",) if c in pieces.columns]))
    names = pieces.columns

    def run(batches):
        first = None
        columns: list[list] = [[] for _ in names]
        at = names.index("length")

        def stream():
            nonlocal first
            n = 0
            for batch in batches:
                if first is None and batch.num_rows:
                    first = batch.column(len(names))[0].as_py()
                cols = [batch.column(i).to_pylist() for i in range(len(names))]
                for c, v in zip(columns, cols):
                    c.extend(v)
                for size in cols[at]:
                    yield size, n
                    n += 1

        def rows(done):
            order = [i for _, items in done for _, i in items]
            seq = [s for s, items in done for _ in items]
            off = []
            for _, items in done:
                o = 0
                for size, _ in items:
                    off.append(o)
                    o += size
            arrays = [pa.array([columns[k][i] for i in order], schema.field(k).type) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

        done: list = []
        for k, items in enumerate(pack_stream(stream(), length, open_bins)):
            done.append((((first or 0) << 33) | k << 1, items))
            if len(done) >= 4096:
                yield rows(done)
                done = []
        if done:
            yield rows(done)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(pieces.schema)
    short = keyed.filter(F.col("length") < length).repartition(tasks, "_h")
    short = short.sortWithinPartitions("_h", *names).withColumn("_task", F.spark_partition_id()).drop("_h")
    packed = short.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")
    whole = keyed.filter(F.col("length") >= length).drop("_h").withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole)


def pack_documents(documents: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = 0, open_bins: int = OPEN_BINS, tokens_per_task: int = TOKENS_PER_TASK, keep_ids: bool = False) -> DataFrame:
    return pack(cut(documents, vocabulary, length, end_id, keep_ids), length, open_bins, tokens_per_task)
