"""Conversation memory over a turns table (conv_id, turn, role, text).

Turns are placed by ranges (ranges.py), unless all conversations fit a task, and worked on in blocks of BLOCK positions, so
that no window, join or text holds a whole conversation of any size; turns with a null conv_id are one. What is kept of one is bounded by the pairs, the kept tail and the cap. Turns that share a number
stand in order of role and text, a null number first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import speaker, tail
from ..shipping import ship
from .ranges import earlier, same
from .scratch import materialize

PAIRS, SUMMARIES, ABSORB_LEAST, DIGEST_CAP = 2, 2, 2, 12_000
BLOCK = 512


def placed(turns: DataFrame) -> DataFrame:
    """The turns with their position pos (from 1) in the conversation and its number of turns n."""
    rows = earlier(turns, ["conv_id"], ["turn", "role", "text"], ["role", "text"], _before=F.lit(1))
    return rows.withColumns({"pos": F.col("_before") + 1, "n": F.col("_before_all")}).drop("_before", "_before_all")


def _block(pos):
    return F.floor((pos - 1) / BLOCK)


def _pairs(at: DataFrame, k: int) -> DataFrame:
    rows = at.select("conv_id", "turn", "role", "text", "pos")
    # The last turn of a block also stands before the first of the next.
    blocks = rows.withColumn("_shift", F.explode(F.when(F.col("pos") % BLOCK == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("_block", _block(F.col("pos")) + F.col("_shift"))
    w = W.partitionBy("conv_id", "_block").orderBy("pos")
    seen = blocks.select("*", F.lag("role").over(w).alias("_role"), F.lag("text").over(w).alias("user"))
    found = seen.filter("_shift = 0 AND role = 'assistant' AND _role = 'user'")
    last = lambda df, *by: df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("pos")))).filter(F.col("_n") <= k)
    # The last of each block first, so that the second window holds k rows a block at most.
    kept = last(last(found, "conv_id", "_block"), "conv_id")
    return kept.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("pos")).alias("pair"), "turn", "user", F.col("text").alias("assistant"), "pos")


def pairs(turns: DataFrame, k: int = PAIRS) -> DataFrame:
    """The last k pairs of a user turn and the assistant turn right after it: conv_id, pair (1 is the oldest), turn, user, assistant."""
    return _pairs(placed(turns), k).drop("pos")


def _recent(at: DataFrame, k: int, limit: int, boundary: str) -> DataFrame:
    edge = _pairs(at, k).groupBy("conv_id").agg((F.max("pos") if boundary == "newest" else F.min("pos")).alias("_p"))
    ends = same(at.groupBy("conv_id").agg(F.max("n").alias("n")), edge, ["conv_id"], "left").withColumn("_end", F.coalesce(F.col("_p") - 2, F.col("n")))
    wanted = ends.filter("_end > 0").select("conv_id", F.explode(F.sequence(F.col("_end") - limit + 1, F.col("_end"))).alias("pos")) if limit > 0 else ends.select("conv_id", F.lit(0).cast("long").alias("pos"))
    return same(at.select("conv_id", "turn", "role", "text", "pos"), wanted, ["conv_id", "pos"]).select("conv_id", "turn", "role", "text")


def recent(turns: DataFrame, k: int = PAIRS, limit: int = SUMMARIES, boundary: str = "newest") -> DataFrame:
    """Up to `limit` turns before the kept pairs. boundary: before the `newest` kept pair (its elders are then covered
    twice) or the `oldest`. Without a pair, the last turns."""
    return _recent(placed(turns), k, limit, boundary)


def _absorbed(at: DataFrame, keep: int, least: int) -> DataFrame:
    return at.filter((F.col("n") - keep >= least) & (F.col("pos") <= F.col("n") - keep))


def absorbed(turns: DataFrame, keep: int = 2 * PAIRS + SUMMARIES, least: int = ABSORB_LEAST) -> DataFrame:
    """All turns but the last `keep`, of conversations where that leaves at least `least`; with pos and n."""
    return _absorbed(placed(turns), keep, least)


def remaining(turns: DataFrame, gone: DataFrame) -> DataFrame:
    return turns.join(gone.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")


def _live(at: DataFrame, keep: int, least: int = ABSORB_LEAST) -> DataFrame:
    """What remains, of placed turns: all of a short conversation, else the last `keep` but those that share a number
    with the last absorbed turn. At most max(keep, keep + least - 1) turns each."""
    edge = F.col("n") - keep
    tail_ = at.filter((edge < least) | (F.col("pos") >= edge))
    last = W.partitionBy("conv_id")
    cut = tail_.withColumn("_cut", F.max(F.when((edge >= least) & (F.col("pos") == edge), F.col("turn"))).over(last))
    return cut.filter((edge < least) | ((F.col("pos") > edge) & ~F.coalesce(F.col("turn") == F.col("_cut"), F.lit(False)))).drop("_cut")


def _lines(rows: DataFrame, order: str, line, sep: str, out: str) -> DataFrame:
    """Per conversation its lines in a row, null if it has none; null lines are none."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), sep)
    return rows.groupBy("conv_id").agg(F.when(F.count(line) > 0, joined).alias(out))


def _line():
    return F.concat(speaker("role"), F.lit(": "), F.col("text"))


def absorb_text(gone: DataFrame) -> DataFrame:
    """The role-tagged lines of the absorbed turns of each conversation, whole; for conversations that fit one text."""
    return _lines(gone, "pos", _line(), "\n", "lines")


def digest(gone: DataFrame, cap: int = DIGEST_CAP) -> DataFrame:
    """The deterministic digest of absorbed turns (with pos): the newest `cap` characters of their lines.

    Lengths are summed backwards, by blocks first; only lines that reach into the last `cap` characters are joined. Null
    lines are none; a conversation without any line has a null digest.
    """
    rows = gone.select("conv_id", "pos", _block(F.col("pos")).alias("_block"), _line().alias("line")).filter("line IS NOT NULL").withColumn("_size", (F.length("line") + 1).cast("long"))
    sums = rows.groupBy("conv_id", "_block").agg(F.sum("_size").alias("_s"))
    later = W.partitionBy("conv_id").orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    near = sums.withColumn("_after", F.coalesce(F.sum("_s").over(later), F.lit(0))).filter(F.col("_after") <= max(cap, 0)).select("conv_id", "_block")
    inside = W.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    reach = same(rows, near, ["conv_id", "_block"]).withColumn("_after", F.coalesce(F.sum("_size").over(inside), F.lit(0))).filter(F.col("_after") <= max(cap, 0))
    found = same(gone.select("conv_id").distinct(), _lines(reach, "pos", tail("line", cap), "\n", "lines"), ["conv_id"], "left")
    return found.select("conv_id", tail("lines", cap).alias("digest"))


def joined_tails(texts: list[str]) -> str:
    """The deterministic merge: all lines in a row."""
    return "\n".join(texts)


def merged_digest(gone: DataFrame, merge: Callable[[list[str]], str] = joined_tails, cap: int = DIGEST_CAP, fan: int = 8) -> DataFrame:
    """The digest of absorbed turns (with pos) by a tree of merges: conv_id, digest.

    Each merge, a summarising model's call for instance, gets up to `fan` texts of at most `cap` characters, in order, and its
    answer is cut to its last `cap`. Nodes of one level are merged in parallel wherever they lie, so a hot conversation takes
    as many rounds as its logarithm, and no call or task holds it. `merge` has to be associative for the tree not to show;
    the default gives the tail of all lines. Null lines are none; a conversation without any line has a null digest.
    """
    ship(gone.sparkSession)

    @F.pandas_udf("string")
    def node(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: merge(list(t))[-cap:])

    keys = gone.select("conv_id").distinct()
    at = gone.select("conv_id", (F.col("pos") - 1).alias("node"), tail(_line(), cap).alias("text")).filter("text IS NOT NULL")
    left = (at.agg(F.max("node")).first()[0] or 0) + 1
    while True:
        grouped = at.groupBy("conv_id", F.floor(F.col("node") / fan).alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]).alias("texts"))
        # Written once a level: a call of a model is not made again for the levels above.
        at = materialize(grouped.select("conv_id", "node", node("texts").alias("text")), "digest-level")
        left = -(-left // fan)
        if left <= 1:
            return same(keys, at.select("conv_id", "text"), ["conv_id"], "left").select("conv_id", F.col("text").alias("digest"))


def text_block(turns: DataFrame, pinned: list[str] | None = None, k: int = PAIRS, limit: int = SUMMARIES, boundary: str = "newest", keep: int = 2 * PAIRS + SUMMARIES, cap: int = DIGEST_CAP) -> DataFrame:
    """One row per conversation: pinned lines, pairs, summaries (here the turns themselves) and digest, blank lines between."""
    at = materialize(placed(turns), "placed-turns")
    gone = _absorbed(at, keep, ABSORB_LEAST)
    live = materialize(_live(at, keep), "live-turns")
    two = _lines(_pairs(live, k), "pair", F.concat(F.lit("User: "), "user", F.lit("\nAssistant: "), "assistant"), "\n\n", "pairs")
    few = _lines(_recent(live, k, limit, boundary), "turn", _line(), "\n", "summaries")
    all_ = turns.select("conv_id").distinct()
    for part in (two, few, digest(gone, cap)):
        all_ = same(all_, part, ["conv_id"], "left")
    head = F.lit("Pinned:\n" + "\n".join(pinned)) if pinned else F.lit(None).cast("string")
    return all_.select("conv_id", F.concat_ws("\n\n", head, "pairs", F.concat(F.lit("Recent summaries:\n"), "summaries"), F.concat(F.lit("Digest:\n"), "digest")).alias("block"))
