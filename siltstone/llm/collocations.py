"""Phrase collocations by Suffix-sigma.

Every word of a piece starts a suffix, truncated to the longest phrase. Equal suffixes of a task are counted together, then
suffixes are shuffled by language and first word and sorted; one stack over the sorted suffixes counts all their prefixes,
which are all phrases. The parts of each candidate are joined to these counts afterwards.

The shuffle deals ranges of (language, first word). Their bounds are drawn from a sample of positions, which decides only
how even the ranges are. A first word that holds more than a range is cut further on, at its second, third or fourth word;
the few phrases that such a bound lies in are counted in parts and summed. A block of suffixes is one row: its words, and
columns of numbers into them, compressed. Tasks hold FLUSH words or a range's suffixes (about RANGE_BYTES of text) at once.
The driver and each task hold the bounds: some 50 bytes for RANGE_BYTES of text.

Edge cases: a null text is empty, a null language is `und`, as are those named so; texts of any length are read in slices,
without a cut in their phrases; repeated rows count as often as they occur; ids are not read, so they may be null; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ship, small_join
from .tokens import slices

LONGEST, LEAST, COVERED, FIRST, SCALE = 4, 30, 80, 2000, 2_000_000
UNKNOWN = "und"

#: Words of a task that are sorted at once, bytes of text that a range stands for, sampled positions of an Arrow batch,
#: and samples that the driver takes for each range.
FLUSH, RANGE_BYTES, SAMPLED, SAMPLES_PER_RANGE = 1 << 20, 6 << 20, 16, 64
#: A language's candidates are ranked in so many parts before its first phrases meet in one task.
RANKED_PARTS = 32

#: Bytes of text that are split into words at once.
SLICE = 4 << 20

_BREAK = b"\n"
_TABLE = bytes(0x0A if c in b".,;:!?\n\v\f\r" else 0x20 if c == 9 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, a line break between pieces; some may be empty."""
    return text.lower().translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")


def suffixes(ids: np.ndarray, starts: int, longest: int) -> np.ndarray:
    """ids: words, 1 between pieces. One row per word among the first `starts`: it and what follows it in its piece, 0 behind."""
    out = np.zeros((len(ids), longest), np.int64)
    open_ = np.ones(len(ids), bool)
    for k in range(longest):
        part = np.append(ids[k:], np.ones(k, np.int64))[: len(ids)]
        open_ &= part > 1
        out[:, k] = np.where(open_, part, 0)
    out = out[:starts]
    return out[out[:, 0] > 0]


def collapsed(lang: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by language and words, equal rows summed."""
    if not len(lang):
        return lang, words, counts
    if words.max() < 1 << 21:
        keys = [words[:, k] << 42 | words[:, k + 1] << 21 | words[:, k + 2] if k + 2 < words.shape[1] else words[:, k] for k in (0, *range(3, words.shape[1]))] if words.shape[1] > 2 else list(words.T)
    else:
        keys = list(words.T)
    order = np.lexsort([*reversed(keys), lang])
    lang, words = lang[order], words[order]
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (words[1:] != words[:-1]).any(1)
    at = np.flatnonzero(new)
    return lang[at], words[at], np.add.reduceat(counts[order], at)


def _planes(a: np.ndarray) -> bytes:
    a = a.astype("<u4" if not len(a) or a.max() < 1 << 32 else "<u8")
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    size = len(raw) // n
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel().astype(np.int64)


def packed(lang: np.ndarray, words: np.ndarray, counts: np.ndarray, langs: list[bytes], vocabulary: list[bytes]) -> bytes:
    """A block: numbers into the languages and words that it holds (0: no word)."""
    used, used_langs = np.unique(words[words > 0]), np.unique(lang)
    columns = [_planes(np.where(c > 0, np.searchsorted(used, c) + 1, 0)) for c in words.T]
    held = ([langs[i] for i in used_langs], b"\n".join([vocabulary[i] for i in used]), len(lang), _planes(np.searchsorted(used_langs, lang)), columns, _planes(counts))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(held, protocol=5))


def unpacked(block: bytes) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    langs, text, n, lang, columns, counts = pickle.loads(zstandard.ZstdDecompressor().decompress(block))
    return langs, text.split(b"\n"), _numbers(lang, n), np.stack([_numbers(c, n) for c in columns], 1), _numbers(counts, n)


class Block:
    """Words of one task until they are sorted."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0, _BREAK: 1}
        self.langs: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.lang_of: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: bytes, words: list[bytes]) -> None:
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        ids = ids[ids > 0]
        self.parts.append(ids)
        self.lang_of.append((self.langs.setdefault(lang, len(self.langs)), len(ids)))
        self.size += len(ids)

    def flush(self, keep: int = 0):
        """Sorted suffixes with counts, languages and words. keep: the last words, which open text may still follow, stay."""
        ids = np.concatenate([np.zeros(0, np.int64), *self.parts])
        closed = np.flatnonzero(ids == 1)
        keep = min(keep, len(ids) - (closed[-1] + 1 if len(closed) else 0))
        starts = len(ids) - keep
        lang = np.repeat([x for x, _ in self.lang_of], [n for _, n in self.lang_of]).astype(np.int64)[:starts][ids[:starts] > 1]
        by_lang, by_word = sorted(self.langs), sorted(w for w in self.numbers if w not in (b"", _BREAK))
        rank = np.zeros(len(self.numbers), np.int64)
        rank[[self.numbers[w] for w in by_word]] = np.arange(1, len(by_word) + 1)
        lang_rank = np.zeros(len(by_lang), np.int64)
        lang_rank[[self.langs[x] for x in by_lang]] = np.arange(len(by_lang))
        words = rank[suffixes(ids, starts, self.longest)]
        words = words.reshape(-1, self.longest)
        found = collapsed(lang_rank[lang], words, np.ones(len(words), np.int64))
        names = {n: w for w, n in self.numbers.items()}
        held = [names[i] for i in ids[starts:].tolist()]
        last = next((x for x, n in reversed(list(self.langs.items())) if n == self.lang_of[-1][0]), None) if held else None
        self.clear()
        if held:
            self.add(last, held)
        return (*found, by_lang, [b"", *by_word])


def prefix_counts(words: np.ndarray, lang: np.ndarray, counts: np.ndarray, least: int, always: set[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """Of sorted suffixes: (a row, how many of its words, occurrences) for every prefix with at least `least` occurrences
    and for those in `always` (language and words). One stack holds the open prefixes' counts by their number of words."""
    n, longest = words.shape
    if not n:
        return []
    equal = np.zeros((n, longest + 1), bool)
    equal[1:, 0] = lang[1:] == lang[:-1]
    for k in range(longest):
        equal[1:, k + 1] = equal[1:, k] & (words[1:, k] == words[:-1, k]) & (words[1:, k] > 0)
    common = equal[:, 1:].sum(1)
    sizes = (words > 0).sum(1)
    out: list[tuple[int, int, int]] = []
    stack, depth = [0] * (longest + 1), 0
    seen = {len(p) - 1 for p in always}
    for row, (shared, size, count) in enumerate(zip(common.tolist(), sizes.tolist(), counts.tolist())):
        while depth > shared:
            total = stack[depth]
            if total >= least:
                out.append((row - 1, depth, total))
            elif depth in seen and (int(lang[row - 1]), *words[row - 1, :depth].tolist()) in always:
                out.append((row - 1, depth, total))
            depth -= 1
            stack[depth] += total
        while depth < size:
            depth += 1
            stack[depth] = 0
        stack[depth] += count
    while depth:
        total = stack[depth]
        if total >= least or (int(lang[-1]), *words[-1, :depth].tolist()) in always:
            out.append((n - 1, depth, total))
        depth -= 1
        stack[depth] += total
    return out


def range_bounds(texts: DataFrame, longest: int = LONGEST, range_bytes: int = RANGE_BYTES) -> list[tuple[bytes, ...]]:
    """First (language, words...) of each range but the first, from a sample of positions; no longer than it must be to
    differ from the bound before."""

    def run(batches):
        for number, batch in enumerate(batches):
            langs, column = batch.column(0), batch.column(1)
            sizes = np.array([len(t.as_buffer() or b"") for t in column], np.int64)
            total = int(sizes.sum())
            rng = np.random.default_rng([number, total, batch.num_rows])
            out: tuple = ([], [], [])
            for at in np.sort(rng.integers(0, total, SAMPLED)).tolist() if total else []:
                row = int(np.searchsorted(np.cumsum(sizes), at, "right"))
                text = memoryview(column[row].as_buffer())
                inside = at - int(sizes[:row].sum())
                found = [t for t in tokens(bytes(text[max(0, inside - 64) : inside + 1024]))[1:] if t][: longest + 1]
                piece = found[: found.index(_BREAK)] if _BREAK in found else found
                for c, v in zip(out, (langs[row].as_py().encode(), piece[:longest], total / SAMPLED)):
                    c.append(v)
            kinds = (pa.binary(), pa.list_(pa.binary()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["lang", "words", "weight"])

    sample = materialize(texts.mapInArrow(run, "lang binary, words array<binary>, weight double"), "sample")
    n, total = sample.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    ranges = max(1, -int(-total // range_bytes))
    part = min(1.0, SAMPLES_PER_RANGE * ranges / max(n, 1))
    drawn = sample if part == 1.0 else sample.sample(part, seed=7)
    rows = sorted(((bytes(r.lang), *map(bytes, r.words)), r.weight) for r in drawn.collect()) if ranges > 1 else []
    sums = np.cumsum([w for _, w in rows])
    out: list[tuple[bytes, ...]] = []
    for k in range(1, ranges) if rows else []:
        full = rows[int(np.searchsorted(sums, sums[-1] * k / ranges))][0]
        bound = next((full[:m] for m in range(2, len(full) + 1) if not out or full[:m] > out[-1]), None)
        if bound:
            out.append(bound)
    return out


def phrase_counts(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, range_bytes: int = RANGE_BYTES, flush: int = FLUSH, slice_bytes: int = SLICE) -> DataFrame:
    """lang, phrase, k (its words), f: all phrases of up to `longest` words that occur at least `least` times in their
    language, and each language's number of words under a null phrase and k = 0. Written once."""
    ship(documents.sparkSession)
    texts = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bounds = range_bounds(texts, longest, range_bytes)

    def deal(batches):
        block = Block(longest)

        def blocks(keep=0):
            lang, words, counts, langs, vocabulary = block.flush(keep)

            class Rows:  # for bisect: the row's key
                __len__ = lambda self: len(lang)
                __getitem__ = lambda self, i: (langs[lang[i]], *[vocabulary[w] for w in words[i] if w])

            rows = Rows()
            low, range_ = 0, bisect_right(bounds, rows[0]) if len(lang) else 0
            while low < len(lang):
                high = bisect_left(rows, bounds[range_], low) if range_ < len(bounds) else len(lang)
                if high > low:
                    part = slice(low, high)
                    yield pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.array([packed(lang[part], words[part], counts[part], langs, vocabulary)], pa.binary())], names=["range", "block"])
                low, range_ = high, range_ + 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                for part in slices(raw, slice_bytes):
                    if block.size >= flush:
                        yield from blocks(longest - 1)
                    block.add(lang.encode(), tokens(part))
                block.add(lang.encode(), [_BREAK])
                if block.size >= flush:
                    yield from blocks()
        yield from blocks()

    def count(table: pa.Table) -> pa.Table:
        range_ = table.column("range")[0].as_py()
        parts = [unpacked(b.as_py()) for b in table.column("block")]
        langs, vocabulary = (sorted(set().union(*(p[k] for p in parts))) for k in (0, 1))
        # Words are parts of one sorted list: the number of a word is its place in it, from 1.
        word_of, lang_of = ({w: i for i, w in enumerate(x, first)} for x, first in ((vocabulary, 1), (langs, 0)))
        lang = np.concatenate([np.array([lang_of[x] for x in p[0]], np.int64)[p[2]] for p in parts])
        words = np.concatenate([np.array([0, *(word_of[w] for w in p[1])], np.int64)[p[3]] for p in parts])
        counts = np.concatenate([p[4] for p in parts])
        del parts
        lang, words, counts = collapsed(lang, words, counts)
        edges = [b for b in (bounds[range_ - 1] if range_ else (), bounds[range_] if range_ < len(bounds) else ())]
        always = {(lang_of[b[0]], *(word_of[w] for w in b[1:m])) for b in edges for m in range(2, len(b)) if b[0] in lang_of and all(w in word_of for w in b[1:m])}
        found = prefix_counts(words, lang, counts, least, always)
        name = [x.decode() for x in langs]
        totals = np.bincount(lang, counts, minlength=len(langs)).astype(np.int64)  # exact: far below 2**53
        out = [(name[lang[row]], b" ".join([vocabulary[w - 1] for w in words[row, :k].tolist()]).decode(), k, f) for row, k, f in found]
        out += [(x, None, 0, int(f)) for x, f in zip(name, totals.tolist())]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["lang", "phrase", "k", "f"])

    blocks = texts.mapInArrow(deal, "range int, block binary")
    parts = blocks.groupBy("range").applyInArrow(count, "lang string, phrase string, k int, f long")
    sums = parts.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))
    return materialize(sums.filter((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of phrase_counts with their lowest-scoring cut: lang, phrase, a, l, r, score."""
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    cuts = counts.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return lowest.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame, counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates without those inside a longer one that has `covered` percent of their occurrences."""
    inner = """explode(array_distinct(flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), s -> array_join(slice(w, s, n), ' '))))))"""
    longer = counts.filter("k > 2").select("lang", "k", "f", F.split("phrase", " ", -1).alias("w")).select("lang", "f", F.expr(inner).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    wide = lambda c: F.col(c).cast("decimal(19, 0)")
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("_most").isNull() | (100 * wide("_most") < covered * wide("a"))).drop("_most")


def collocations(documents: DataFrame, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, occurrences and phrase."""
    counts = phrase_counts(documents)
    left = uncovered(scored(counts), counts)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS)))
    parts = parts.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*best))).filter(F.col("_n") <= first)
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= first)
    words = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return small_join(ranked, words, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
