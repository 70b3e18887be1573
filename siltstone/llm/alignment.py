"""Alignment of two tokenizers' ids over the bytes of each text.

Both encode the same bytes: a space and the text. The ends of both token sequences are united (union1d) into elementary
intervals; a binary search of each interval finds its owner on either side, so each interval is one overlap of an A token
with a B token. Ends that both share close groups. `groups` and `overlaps` give these, `products` expands a group into all
its pairs, and links are the pairs whose ranges end together, that is a group's last A and last B token.

Corpus counts of linked id pairs come from one aggregate over each document's distinct pairs. To look them up again per
document, the pairs that hold at least 1/HEAVY of all links (so at most HEAVY of them, whatever the corpus) go to the tasks
as two sorted arrays; all others are joined by a shuffle, in which no pair can be hot.

Edge cases: texts that are null or empty, or that either vocabulary does not keep byte for byte (with U+2581, say), have no
tokens: all numbers are 0 and the digest is an empty string. Names of special tokens are plain text. Repeated rows and ids
count as often as they occur, null ids are allowed, a very long text is encoded in chunks, an empty table gives an empty
result, and other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytelevel import ByteLevelIds, Cache, by_chunks, byte_table, chunks, plain_words
from .common import materialize, scratch_path, ship
from .tokens import vocabulary_path

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: A pair with at least 1/HEAVY of all links is looked up in the tasks (16 bytes a pair), any other by a join.
HEAVY = 100_000

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"

_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: Letter runs and other runs of a text that plain_words() holds for.
_RUNS = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[^A-Za-z\x80-\xff ]+| ")
_MIXED = re.compile(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]")


class Pair:
    """Both tokenizers: ids of space + text, and each id's bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        b = SentencePieceProcessor(model_file=b_path)
        level = byte_table()
        special = {i for i, t in a.get_added_tokens_decoder().items() if t.special}
        spell = lambda i: a.id_to_token(i).encode() if i in special else bytes(level[c] for c in (a.id_to_token(i) or ""))
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.a_bytes = [spell(i) for i in range(a.get_vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if b.is_byte(i) and (m := _BYTE.match(p)) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._b, self._space = b.encode, b.piece_to_id("▁")
        self._a_ids = ByteLevelIds(a_path, plain=True).encode
        # Parts are encoded by themselves only if no piece lies across their edges.
        texts = [p.lstrip("▁") for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        self._whole = any("▁" in p or "\n" in p for p in texts) or b.encode("\n") != [self._space, b.piece_to_id("<0x0A>")]
        self._by_runs = not any(map(_MIXED.search, texts))
        self._b_ids = Cache(self._encode).__getitem__
        self._raw = [i.to_bytes(4, "little") for i in range(len(pieces))]
        # A byte-level vocabulary with a token for every byte keeps every text.
        self._exact = {bytes([i]) for i in range(256)} <= set(self.a_bytes) and by_chunks(json.loads(a.to_str()))

    def _encode(self, part: bytes) -> tuple[bytes, bool]:
        """B adds a space: a part that starts with one goes without it, any other behind a line break, whose ids go. Also:
        are the ids' bytes the part's?"""
        s = part.decode("utf-8", "replace")
        ids = [self._space] if s == " " else self._b(s[1:]) if s[:1] == " " else self._b("\n" + s)[2:]
        return b"".join([self._raw[i] for i in ids]), b"".join([self.b_bytes[i] for i in ids]) == part

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text on both sides; none if their bytes are not these."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spaced = b" " + text
        parts = [spaced] if self._whole else _RUNS.findall(spaced) if self._by_runs and plain_words(spaced) else chunks(spaced)
        found, kept = zip(*map(self._b_ids, parts))
        a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in (self._a_ids(spaced), b"".join(found)))
        sides = ((self.a_bytes, a, self._exact), (self.b_bytes, b, all(kept)))
        same = all(ok or b"".join(map(t.__getitem__, ids.tolist())) == spaced for t, ids, ok in sides)
        return (a, b) if same else (a[:0], b[:0])


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals by their ends, and the A and the B token that each lies in."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A and the last B token of each group: both own the interval whose end is an end of theirs."""
    ends, a, b = overlaps(ends_a, ends_b)
    shared = (ends_a[a] == ends) & (ends_b[b] == ends) if len(ends) else np.zeros(0, bool)
    return a[shared], b[shared]


def products(last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of one group."""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    n = n_a * n_b
    group = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return (last_a - n_a + 1)[group] + i // n_b[group], (last_b - n_b + 1)[group] + i % n_b[group]


def digits(count: int) -> np.ndarray:
    """Decimal ids as rows of ASCII, padded with zero bytes."""
    width = len(str(max(count - 1, 0)))
    return np.array([str(i).encode() for i in range(count)], f"S{width}").view(np.uint8).reshape(count, width)


def spelled(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, names: np.ndarray) -> bytes:
    """Groups as text: a1,a2|b1;a3|b2,b3"""
    if not len(a):
        return b""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)  # behind the B tokens of all groups before
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)  # and the A tokens of these and the own group
    out = np.full((len(a) + len(b), names.shape[1] + 1), ord(","), np.uint8)
    out[at_a, :-1], out[at_b, :-1] = names[a], names[b]
    out[at_a[last_a], -1], out[at_b[last_b], -1] = ord("|"), ord(";")
    flat = out.ravel()
    return flat[flat > 0][:-1].tobytes()


_pairs: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One per worker process and vocabularies."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY)


SPANS = "doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>, overlaps array<struct<a: int, b: int, bytes: int>>"


def spans(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Each document's ids, the last token of each group on either side, and its overlaps with their lengths."""
    ship(documents.sparkSession)
    paths = _paths(a_path, b_path)

    def run(batches):
        p = pair(*paths)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = p.encode(text.as_py() or b"")
                ends_a, ends_b = np.cumsum(p.a_sizes[a]), np.cumsum(p.b_sizes[b])
                ends, own_a, own_b = overlaps(ends_a, ends_b)
                last_a, last_b = groups(ends_a, ends_b)
                cut = [{"a": x, "b": y, "bytes": n} for x, y, n in zip(own_a.tolist(), own_b.tolist(), np.diff(ends, prepend=0).tolist())]
                out.append((doc_id, a.tolist(), b.tolist(), last_a.tolist(), last_b.tolist(), cut))
            ints = pa.list_(pa.int32())
            kinds = (pa.int64(), ints, ints, ints, ints, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["doc_id", "a", "b", "group_a", "group_b", "overlaps"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SPANS)


def linked(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document, written once: numbers, digest of the groups, its distinct linked pairs (A id << 32 | B id) in
    ascending order and how often it links each. row numbers rows."""
    ship(documents.sparkSession)
    paths = _paths(a_path, b_path)

    def run(batches):
        p, task = pair(*paths), TaskContext.get().partitionId() << 40
        names = digits(max(len(p.a_bytes), len(p.b_bytes)))
        for batch in batches:
            stats, found, times, n = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = p.encode(text.as_py() or b"")
                last_a, last_b = groups(np.cumsum(p.a_sizes[a]), np.cumsum(p.b_sizes[b]))
                pairs, counts = np.unique(a[last_a] << 32 | b[last_b], return_counts=True)
                sha = hashlib.sha256(spelled(a, b, last_a, last_b, names)).hexdigest() if len(a) else ""
                stats.append((task, doc_id, len(a), len(b), len(last_a), len(last_a), sha))
                found.append(pairs)
                times.append(counts)
                n.append(len(pairs))
                task += 1
            ends = pa.array(np.cumsum([0, *n]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([[], *x]), k)) for x, k in ((found, pa.int64()), (times, pa.int32()))]
            kinds = (*[pa.int64()] * 6, pa.string())
            plain = [pa.array(c, k) for c, k in zip(zip(*stats) if stats else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([*plain, *lists], names=[x.split()[0] for x in ROWS.split(", ")])

    path = scratch_path(documents.sparkSession, "linked")
    documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, ROWS).write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(ROWS).parquet(path)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Corpus-wide: pair, count (its links), best (no pair of its B id has more)."""
    one = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count"))
    one = materialize(one, "pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    top = one.groupBy("b").agg(F.max("count").alias("most"))
    return materialize(one.join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = linked(documents, a_path, b_path)
    counts = pair_counts(rows)
    links = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = counts.filter(F.col("count") * F.lit(heavy) >= F.lit(links)).toPandas().sort_values("pair")  # at most `heavy` rows
    keys, known, best = (often[c].to_numpy() for c in ("pair", "count", "best"))

    def run(batches):
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            sizes = np.diff(c["pairs"].offsets.to_numpy())
            pairs, times = (c[x].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pairs", "counts"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1) if len(keys) else np.zeros(len(pairs), np.int64)
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            total, good = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, row[hit], known[at[hit]] * times[hit])
            np.add.at(good, row[hit], np.where(best[at[hit]], times[hit], 0))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hit], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([c["row"], pa.array(good), pa.array(total), *rest], names=["row", "n_best", "count_sum", "pairs", "counts"])

    looked = materialize(rows.select("row", "pairs", "counts").mapInArrow(run, "row long, n_best long, count_sum long, pairs array<long>, counts array<long>"), "looked")
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
    # Broadcasting by size would be right, too; the hint only keeps the plan the same at every size.
    rare = rare.join(counts.filter(F.col("count") * F.lit(heavy) < F.lit(links)).hint("merge"), "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("count") * F.col("times")).alias("count_sum"))
    sums = looked.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "counts").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
