"""Loop detection over deltas that come in any order, with state by key in RocksDB.

Each reference has one value (the text's tail and counts) and a map of the deltas that
came before their turn; a timer gives up texts that stop growing, and a time to live
clears what a lost timer leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheafline.shipping import ship
from sheafline.streaming.detector import EVERY, OUTPUT, TAIL, loop_in, loop_since

ship(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


class Text:
    """A text that grows, and what loop it shows; of its characters the last `tail` are held."""

    def __init__(self, every: int, tail: int, held: str = "", chars: int = 0, checked: int = 0, reason: str | None = None):
        self.every, self.tail, self.held, self.chars, self.checked, self.reason = every, max(tail, every), held, chars, checked, reason

    def add(self, delta: str | None) -> None:
        if self.reason is not None or not delta:
            return
        self.chars += len(delta)
        if self.chars - self.checked >= self.every:
            self.checked, self.reason = self.chars, loop_since(self.held, delta, self.every, self.tail)
        self.held = (self.held + delta)[-self.tail :]

    def end(self) -> str | None:
        """What the whole text shows, with its unchecked end."""
        if self.reason is None and self.chars > self.checked:
            self.reason = loop_in(self.held)
        return self.reason


class InOrder(StatefulProcessor):
    """Puts deltas of a reference in the order of their seq, from 0 without gaps, and checks the text."""

    def __init__(self, every: int, tail: int, timeout_ms: int | None):
        self.every, self.tail, self.timeout_ms = every, tail, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        live = {"ttlDurationMs": 4 * self.timeout_ms} if self.timeout_ms else {}
        self.handle = handle
        self.text = handle.getValueState("text", "held string, chars long, checked long, reason string, next long", **live)
        self.waiting = handle.getMapState("waiting", "seq long", "delta string, last boolean", **live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, chars, checked, reason, turn = self.text.get() if self.text.exists() else ("", 0, 0, None, 0)
        text = Text(self.every, self.tail, held, chars, checked, reason)
        said, ended = reason, False
        came = {}
        for pdf in rows:
            ends = pdf["finish_reason"].notna() if "finish_reason" in pdf else [False] * len(pdf)
            came |= {int(s): (d, bool(e)) for s, d, e in zip(pdf["seq"], pdf["delta"], ends) if int(s) >= turn}
        while not ended:
            if turn in came:
                delta, ended = came.pop(turn)
            elif self.waiting.exists() and self.waiting.containsKey((turn,)):
                delta, ended = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                break
            text.add(delta)
            turn += 1
        if ended:
            text.end()
            self.gone()
        else:
            for seq, (delta, last) in came.items():
                # Of a text that looped only the order is kept, so that its end is seen.
                self.waiting.updateValue((seq,), (delta if text.reason is None else None, last))
            self.text.update(("" if text.reason else text.held, text.chars, text.checked, text.reason, turn))
            self.wait(timerValues)
        if text.reason is not None and said is None:
            yield pd.DataFrame([(key[0], text.chars, text.reason)], columns=["ref", "chars", "reason"])

    def wait(self, timerValues) -> None:
        """A new timer in place of the old one."""
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A text that stopped: what came out of turn is read over the gaps."""
        held, chars, checked, said, _ = self.text.get() if self.text.exists() else ("", 0, 0, None, 0)
        text = Text(self.every, self.tail, held, chars, checked, said)
        for _, (delta, _) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if self.waiting.exists() else []:
            text.add(delta)
        self.gone()
        if said is None:
            yield pd.DataFrame([(key[0], text.chars, text.end() or "timeout")], columns=["ref", "chars", "reason"])

    def gone(self) -> None:
        self.text.clear()
        self.waiting.clear()
        for timer in list(self.handle.listTimers()) if self.timeout_ms else []:
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def check_ordered(deltas: DataFrame, every: int = EVERY, tail: int = TAIL, timeout_ms: int | None = 300_000) -> DataFrame:
    """(ref, chars, reason), as detector.check_batch says of the same deltas, however a stream of them is mixed.

    deltas: ref, seq (from 0, one by one), delta and, where the end of a text is known,
    finish_reason in its last row. A delta that comes before its turn waits in state; one
    that comes twice counts once. With timeout_ms a text that does not grow for so long is
    given up (reason timeout, or the loop that its end shows). The session's state store
    becomes RocksDB, which this needs.
    """
    deltas.sparkSession.conf.set(STORE, ROCKSDB)
    return deltas.groupBy("ref").transformWithStateInPandas(InOrder(every, tail, timeout_ms), OUTPUT, "append", "ProcessingTime" if timeout_ms else "None")
