"""Paragraph-aware chunks.

Paragraphs are parted by blank lines; one longer than the limit is split by size, and only what came from such a split
may be cut again. Packing fills chunks up to the limit with a blank line between parts. Afterwards every chunk but the
last is raised to the wished minimum with parts of the next one, as far as the limit allows; with a minimum above the
limit, neighbours are merged whole instead.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip
from ..shipping import ship, small_batches
from .chunk_size import split_by_size
from .pack import context_text
from .ranges import earlier, fit_tasks, ranged, ranges_for, running

BLANK = "\n\n"
_GAP = re.compile(r"\n\s*\n")
#: Texts whose chunks a task holds at once.
TEXTS = 100


@dataclass
class Part:
    text: str
    cuttable: bool
    gap: bool = False  # a blank line stands before it


@dataclass
class Chunk:
    parts: deque[Part] = field(default_factory=deque)
    size: int = 0

    def put(self, text: str, cuttable: bool, gap: bool) -> None:
        self.parts.append(Part(text, cuttable, gap))
        self.size += len(text) + 2 * gap

    def head(self) -> Part | None:
        """The first part, with nothing before it."""
        if self.parts and self.parts[0].gap:
            self.parts[0].gap = False
            self.size -= 2
        return self.parts[0] if self.parts else None

    def drop(self, chars: int) -> None:
        """Take so many characters off the first part; all of them take the part."""
        part = self.parts[0]
        self.size -= chars
        if chars < len(part.text):
            part.text = part.text[chars:]
        else:
            self.parts.popleft()

    def text(self) -> str:
        return "".join((BLANK if p.gap else "") + p.text for p in self.parts)


def paragraphs(text: str) -> list[str]:
    return [p for raw in _GAP.split(text) if (p := raw.strip())]


def packed(parts: list[tuple[str, bool]], limit: int) -> list[Chunk]:
    chunks: list[Chunk] = []
    for text, cuttable in parts:
        last = chunks[-1] if chunks else None
        gap = bool(last and last.size)
        if last is None or last.size + len(text) + 2 * gap > limit:
            if last is not None and not last.parts:
                chunks.pop()
            chunks.append(last := Chunk())
            gap = False
        last.put(text, cuttable, gap)
    return chunks


def _takes(part: Part, room: int) -> int:
    """How much of a part may move into so much room: a cuttable part in part, any other whole or not at all."""
    if part.cuttable:
        return min(room, len(part.text))
    return len(part.text) if len(part.text) <= room else -1


def _raise(chunks: list[Chunk], limit: int, least: int) -> None:
    i = 0
    while i < len(chunks) - 1:
        chunk = chunks[i]
        while chunk.size < least and i < len(chunks) - 1:
            donor, room = chunks[i + 1], limit - chunk.size - 2
            if room <= 0:
                break
            part = donor.head()
            if part is None:
                del chunks[i + 1]
                continue
            n = _takes(part, room)
            # A cuttable part that is empty gives nothing and stops the borrowing.
            if n < 0 or (n == 0 and part.cuttable):
                break
            chunk.put(part.text[:n], part.cuttable, chunk.size > 0)
            donor.drop(n)
            if donor.head() is None:
                del chunks[i + 1]
        i += 1


def _absorb_tail(chunks: list[Chunk], limit: int, least: int) -> None:
    if len(chunks) < 2 or chunks[-1].size >= least:
        return
    into, donor = chunks[-2], chunks[-1]
    while (part := donor.head()) is not None and (room := limit - into.size - 2) > 0:
        n = _takes(part, room)
        if n < 0 or (n == 0 and part.cuttable):
            break
        into.put(part.text[:n], part.cuttable, bool(into.parts))
        donor.drop(n)
    if not donor.parts:
        chunks.pop()


def _merge(chunks: list[Chunk], least: int) -> None:
    i = 0
    while i < len(chunks) - 1:
        if chunks[i].size >= least:
            i += 1
            continue
        donor = chunks.pop(i + 1)
        gap = bool(chunks[i].parts)
        if donor.head() is not None:
            first = donor.parts.popleft()
            chunks[i].put(first.text, first.cuttable, gap)
            for p in donor.parts:
                chunks[i].put(p.text, p.cuttable, p.gap)


def chunk_plain(text: str, limit: int, least: int) -> list[str]:
    parts: list[tuple[str, bool]] = []
    for p in paragraphs(text or ""):
        if len(p) <= limit or limit <= 0:
            parts.append((p, len(p) > limit))
        else:
            parts.extend((s, True) for s in split_by_size(p, limit))
    chunks = packed(parts, limit)
    if least <= limit:
        _raise(chunks, limit, least)
        _absorb_tail(chunks, limit, least)
    else:
        _merge(chunks, least)
    return [s for c in chunks if (s := c.text())]


def paragraph_array(text: Column | str) -> Column:
    """Paragraphs as a column."""
    return F.filter(F.transform(F.split(text, rf"\n[{WS}]*\n"), strip), lambda p: p != "")


def split_rows(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, pos, paragraph) of the group's texts joined by blank lines. A blank line parts paragraphs anyway, so each
    text is split by itself and its paragraphs are numbered from the counts before it; no text holds a group."""
    split = paragraph_array(text)
    counted = earlier(df.select(group, order, text), [group], [order, text], [text], _before=F.coalesce(F.size(F.when(F.col(text).isNotNull(), split)), F.lit(0)))
    return counted.select(group, "_before", F.posexplode(split).alias("i", "paragraph")).select(group, (F.col("_before") + F.col("i")).cast("int").alias("pos"), "paragraph")


def packed_rows(df: DataFrame, group: str, order: str, text: str, limit: int) -> DataFrame:
    """(group, chunk_idx, content): the paragraphs of split_rows packed, for paragraphs that all fit the limit: chunks
    before any borrowing.

    Only lengths are followed from row to row, range by range. A group that goes over several ranges hands each range
    the size of its open chunk and its number of chunks; a first pass tells for each of its ranges what every possible
    open chunk leads to, in one small row a range, and the driver follows these. Texts meet a chunk at a time.
    """
    spark = df.sparkSession
    if fit_tasks(df, [group], [text]):
        whole = context_text(df, [group], order, text, BLANK).select(group, F.posexplode(packed_paragraphs("context", limit)).alias("chunk_idx", "content"))
        return whole.select(group, "chunk_idx", "content")
    rows = ranged(df.select(group, order, text), [group], [order, text], ranges_for(df, [text]))
    sizes = rows.select(group, "_range", "_k", F.when(F.col(text).isNotNull(), F.transform(paragraph_array(text), F.length)).alias("sizes"))
    ones = running(sizes, [group]).select("_range", "_k", "_low", "_before", "_total", F.coalesce("sizes", F.array().cast("array<int>")).alias("sizes"))
    here = ones.groupBy("_range", "_low").agg(F.count("*").alias("_here"), F.min("_before").alias("_first"))
    wide = ones.join(here, ["_range", "_low"]).filter("_here < _total").select("_range", "_low", "_k", "_first", "sizes")

    def lead(pdf):
        """Of a group's rows in a range: what an open chunk of any size leads to."""
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("_k")
        flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["sizes"]] or [np.zeros(0, np.int64)])
        m, ends = len(flat), np.concatenate([[0], np.cumsum(flat + 2)]).astype(np.int64)
        after = np.maximum(np.searchsorted(ends, ends[:-1] + 2 + limit, "right") - 1, np.arange(m) + 1)
        size, starts = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
        for j in range(m - 1, -1, -1):
            t = after[j]
            starts[j] = 1 + starts[t]
            size[j] = ends[m] - ends[j] - 2 if t == m else size[t]
        to = int(np.searchsorted(ends, limit, "right"))
        return pd.DataFrame({"_range": [pdf["_range"].iloc[0]], "_low": [pdf["_low"].iloc[0]], "first": [pdf["_first"].iloc[0] == 0], "m": [m], "chars": [int(ends[m])], "ends": [ends[:to].tolist()], "size": [size[:to].tolist()], "starts": [starts[:to].tolist()]})

    leads = wide.groupBy("_range", "_low").applyInPandas(lead, "_range long, _low long, first boolean, m long, chars long, ends array<long>, size array<long>, starts array<long>")
    states, open_, chunks = [], 0, 0
    for r in sorted(leads.collect(), key=lambda r: (r["_range"], r["_low"])):
        if r["first"]:
            open_, chunks = 0, 0
        states.append((r["_range"], r["_low"], open_, chunks))
        if r["m"]:
            j = max(bisect_right(r["ends"], limit - open_) - 1, 0) if open_ else 0
            if open_ and j == r["m"]:
                open_ += r["chars"]
            else:
                open_, chunks = r["size"][j], chunks + r["starts"][j]
    state = spark.createDataFrame(states, "_range long, _low long, _open long, _chunks long")
    given = ones.select("_range", "_low", "_k", "sizes").join(F.broadcast(state), ["_range", "_low"], "left").fillna(0, ["_open", "_chunks"])

    def follow(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_k")
        out, low = [], None
        for at, size, chunks, parts in zip(pdf["_low"], pdf["_open"], pdf["_chunks"], pdf["sizes"]):
            if at != low:
                low, open_, n = at, int(size), int(chunks)
            idx = []
            for x in parts:
                if open_ and open_ + 2 + x <= limit:
                    open_ += 2 + int(x)
                else:
                    open_, n = int(x), n + 1
                idx.append(n - 1)
            out.append(idx)
        return pd.DataFrame({"_range": pdf["_range"], "_k": pdf["_k"], "idx": out})

    placed = given.groupBy("_range").applyInPandas(follow, "_range long, _k long, idx array<int>").filter(F.size("idx") > 0)
    pieces = rows.select(group, "_range", "_k", paragraph_array(text).alias("p")).join(placed, ["_range", "_k"])
    one = pieces.select(group, "_range", "_k", F.posexplode(F.arrays_zip("p", "idx")).alias("i", "x")).select(group, F.col("x.idx").alias("chunk_idx"), "_range", "_k", "i", F.col("x.p").alias("t"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_k", "i", "t"))), lambda x: x["t"]), BLANK)
    return one.groupBy(group, "chunk_idx").agg(content.alias("content"))


def packed_paragraphs(text: Column | str, limit: int) -> Column:
    """Packing as a column, for paragraphs that all fit the limit: chunks before any borrowing."""
    paras = paragraph_array(text)
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        fits = (s["open"] == "") | (F.length(s["open"]) + 2 + F.length(p) <= limit)
        grown = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit(BLANK), p))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits, grown).otherwise(p).alias("open"))

    return F.aggregate(paras, first, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def chunk_table(df: DataFrame, key: str, text: str, limit: int, least: int) -> DataFrame:
    """(key, chunk_idx, content): all phases, TEXTS texts at a time."""
    kind = df.schema[key].dataType.simpleString()
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches):
        for batch in (b.slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS)):
            keys, idx, out = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(chunk_plain(t, limit, least)):
                    keys.append(k)
                    idx.append(i)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(idx, pa.int32()), pa.array(out, pa.string())], names=[key, "chunk_idx", "content"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_idx int, content string")
