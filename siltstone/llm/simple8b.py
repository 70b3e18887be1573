"""Token ids in files of word-aligned Simple-8b code.

Every 64-bit word holds a 4-bit selector and 60 bits of data: so many ids of so many bits each. Selector 0 is the
escape: the next word is one raw 64-bit id that 60 bits can't hold. Ids are coded in blocks of BLOCK ids; the offsets of
the blocks' first words stand before the words, so a reader can decode any block alone, and each block's words are
decoded selector by selector with whole-array shifts.

A shard (one row of the Parquet files written, any store that Spark writes to will do) is
  magic b"S8B1", then little-endian: u32 documents, u64 ids, u32 blocks, u64 words,
  u32 * documents: ids of each document, u64 * (blocks + 1): offset of each block's first word, u64 * words.
The rows also carry doc_ids, in ascending order, and `before`, the ids of earlier shards of the part; shards are in
ascending order of (part, shard). A part is one range of (doc_id, hash of the text, place in the input), so an id that
many rows share is spread.

Edge cases: a null or empty text is the end id alone; a null doc_id comes first; rows that share a doc_id stand in text
order; an empty table writes no shard and reads back empty; other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch_path, ship, small_join
from .tokens import encoder, vocabulary_path

#: Ids per word and bits per id of selectors 1 to 15 (fixed values of the format).
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0

BLOCK = 1024
SHARD_IDS = 1 << 20
MAGIC = b"S8B1"
#: Columns of the files.
FILES = "part int, shard int, before long, n_ids long, doc_ids array<long>, data binary"
_HEAD = struct.Struct("<4sIQIQ")


_WIDTH16 = np.zeros(1 << 16, np.uint8)
for _b in range(16):
    _WIDTH16[1 << _b : 2 << _b] = _b + 1


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not len(v) or int(v.max()) < 1 << 16:
        return _WIDTH16[v]
    w = np.zeros(v.shape, np.uint8)
    for s in (0, 16, 32, 48):
        part = (v >> np.uint64(s)).astype(np.uint16)
        w = np.where(part != 0, _WIDTH16[part] + np.uint8(s), w)
    return w


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids (unsigned) to (words, block offsets)."""
    v = np.ascontiguousarray(ids, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    width = _widths(v)
    room = np.tile(np.arange(BLOCK, 0, -1, dtype=np.uint16), blocks)[:n]  # ids left in the block
    room[(blocks - 1) * BLOCK :] = np.arange(n - (blocks - 1) * BLOCK, 0, -1)
    best = np.where(width <= BITS[15], np.uint8(15), np.uint8(ESCAPE))
    # A selector of more ids has fewer bits, so where one fails all that follow do.
    most = width.copy()
    for sel in range(14, 0, -1):
        for j in range(COUNTS[sel + 1], min(COUNTS[sel], n)):
            np.maximum(most[: n - j], width[j:], out=most[: n - j])
        fits = (most <= BITS[sel]) & (room >= COUNTS[sel])
        if not fits.any():
            break
        best[fits] = sel
    # Every block's words follow from its start: all blocks step on together.
    step = COUNTS[best]
    step[best == ESCAPE] = 1
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    found = []
    while len(at):
        found.append(at)
        at = at + step[at]
        more = at < end
        at, end = at[more], end[more]
    starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    sel = best[starts]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        mine, where = starts[sel == s], place[sel == s]
        word = np.full(len(mine), s << 60, np.uint64)
        if s == ESCAPE:
            words[where + 1] = v[mine]
        elif BITS[s]:
            for k in range(COUNTS[s]):
                word |= v[mine + k] << np.uint64(int(BITS[s]) * k)
        words[where] = word
    offsets = np.append(place[np.searchsorted(starts, np.arange(blocks) * BLOCK)], len(words))
    return words, offsets.astype(np.uint64)


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks' words."""
    w = np.ascontiguousarray(words, np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    if (sel == ESCAPE).any():  # the word after an escape is data, whatever its top bits say
        at, skip = 0, np.flatnonzero(sel == ESCAPE).tolist()
        for i in skip:
            if i >= at:
                raw[i + 1] = True
                at = i + 2
    count = np.where(raw, 0, np.where(sel == ESCAPE, 1, COUNTS[sel]))
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel[~raw]):
        where = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[place[where]] = w[where + 1]
            continue
        mask, word, at = np.uint64((1 << int(BITS[s])) - 1), w[where], place[where]
        for k in range(COUNTS[s] if BITS[s] else 0):
            out[at + k] = word >> np.uint64(int(BITS[s]) * k) & mask
    return out


def pack_shard(lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = encode_words(ids)
    return b"".join([_HEAD.pack(MAGIC, len(lengths), len(ids), len(offsets) - 1, len(words)), np.array(lengths, "<u4").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A shard's (ids of each document, all ids)."""
    magic, docs, n, blocks, words = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b shard")
    at = _HEAD.size
    lengths = np.frombuffer(data, "<u4", docs, at)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at + 4 * docs)
    w = np.frombuffer(data, "<u8", words, at + 4 * docs + 8 * (blocks + 1))
    ids = decode_words(w[int(offsets[0]) : int(offsets[-1])])
    if len(ids) != n:
        raise ValueError("damaged Simple-8b shard")
    return lengths, ids


def read_block(data: bytes, block: int) -> np.ndarray:
    """One block's ids, without decoding the others."""
    _, docs, _, blocks, words = _HEAD.unpack_from(data)
    at = _HEAD.size + 4 * docs
    lo, hi = np.frombuffer(data, "<u8", blocks + 1, at)[block : block + 2]
    return decode_words(np.frombuffer(data, "<u8", words, at + 8 * (blocks + 1))[int(lo) : int(hi)])


def write(documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> str:
    """Tokenize and write documents in ascending doc_id order; returns path."""
    spark = documents.sparkSession
    ship(spark)
    voc, tail = vocabulary or vocabulary_path(), end_id.to_bytes(4, "little")

    def run(batches):
        enc, shard = encoder(voc), 0
        part, before, docs, lengths, held, size = 0, 0, [], [], [], 0

        def row():
            data = pack_shard(lengths, np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["part", "shard", "before", "n_ids", "doc_ids", "data"])

        for batch in batches:
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = enc.encode(text.as_py() or b"") + tail
                docs.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= shard_ids:
                    yield row()
                    docs, lengths, held, size, shard, before = [], [], [], 0, shard + 1, before + size
        if docs:
            yield row()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Bounds of ranges are drawn from ids, hashes and places, never from texts.
    cols = documents.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("tie")]
    rows = cols.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows.mapInArrow(run, FILES).write.parquet(path)
    return path


def read(spark: SparkSession, path: str, keep_ids: bool = False, most: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids. The parts' starts
    (one number for each range partition that was written) are broadcast if they were counted and are at most `most`."""
    ship(spark)
    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for at, docs, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lengths, ids = read_shard(data.as_py())
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                parts = [raw[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist())]
                arrays = [pa.array(docs, pa.int64()), pa.array(begins + at), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(parts, pa.binary())] if keep_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids])

    return small_join(files, starts, ["part"], "inner", most).select((F.col("base") + F.col("before")).alias("at"), "doc_ids", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


def round_trip(documents: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    spark = documents.sparkSession
    return read(spark, write(documents, scratch_path(spark, "token-files"), vocabulary, end_id))
