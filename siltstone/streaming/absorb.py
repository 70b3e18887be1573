"""Conversation memory as a stateful stream: append, absorb over a threshold, prune, and let idle conversations go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "conv_id long, digest string, live long, absorbed long"
TURNS, DIGEST = "turn long, role string, text string", "digest string, absorbed long"

#: State with lists and timers needs this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined_lines(digest: str, lines: str) -> str:
    """The deterministic digest: old text, then the new lines."""
    return f"{digest}\n{lines}" if digest else lines


class Absorber(StatefulProcessor):
    """State of a conversation: the list of its turns not yet absorbed, its digest, and a timer from its last turn."""

    def __init__(self, trigger: int, keep: int, cap: int, merge: Callable[[str, str], str], idle_ms: int | None) -> None:
        self.trigger, self.keep, self.cap, self.merge, self.idle_ms = trigger, keep, cap, merge, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns, self.digest = handle.getListState("turns", TURNS), handle.getValueState("digest", DIGEST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(None if pd.isna(n) else int(n), None if pd.isna(r) else r, None if pd.isna(t) else t) for pdf in rows for n, r, t in zip(*(pdf[c].tolist() for c in ("turn", "role", "text")))]
        live = sorted([*map(tuple, self.turns.get()), *new], key=lambda t: (t[0] is not None, t[0] or 0))
        digest, done = tuple(self.digest.get()) if self.digest.exists() else ("", 0)
        old = live[: max(0, len(live) - self.keep)] if len(live) >= self.trigger else []
        if len(old) >= 2:
            digest = self.merge(digest, "\n".join(f"{(r or '').capitalize()}: {t or ''}" for _, r, t in old))[-self.cap :]
            live, done = live[len(old) :], done + len(old)
            self.turns.put(live) if live else self.turns.clear()
        else:
            self.turns.appendList(new)
        self.digest.update((digest, done))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"conv_id": pd.array([key[0]], "Int64"), "digest": [digest], "live": [len(live)], "absorbed": [done]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.digest.clear()
        return iter(())

    def close(self) -> None:
        pass


def absorb_stream(turns: DataFrame, trigger: int = 6, keep: int = 6, cap: int = 12_000, merge: Callable[[str, str], str] = joined_lines, idle_ms: int | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per conversation and batch: its digest, live and absorbed turns.

    The state of a conversation holds its digest (at most `cap` characters) and the turns not yet absorbed. With `idle_ms` it
    goes when the conversation has been idle for so long, and one that comes back starts anew (what it had is in the rows
    before); timers are looked at in batches without data too, so such a query runs by a processing-time trigger.
    A null turn number comes first; a null role or text is an empty one; turns without a conv_id are one conversation.
    The session's state store is set to the one that keeps lists and timers, which the query needs when it starts.
    """
    turns.sparkSession.conf.set(STORE, ROCKS)
    return turns.groupBy("conv_id").transformWithStateInPandas(Absorber(trigger, keep, cap, merge, idle_ms), OUT, "Update", "None" if idle_ms is None else "ProcessingTime")
