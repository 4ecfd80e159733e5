"""Loop detection while text is still being written, and event-time roll-ups."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheafline.functions.text import ITEM_PAIR, STRUCTURE
from sheafline.operators.loops import CYCLE_REPEATS, MAX_PERIOD, SINGLE_REPEATS
from sheafline.shipping import ship

ship(__name__)

#: Characters between checks, and the characters of a text that are kept at least.
EVERY, TAIL = 500, 20_000
#: What a run of one character, a repeated n-gram and an item with its total look like (fixed values).
RUN = re.compile(r"([^\d\s])\1{5,}")
NGRAMS = [re.compile(rf"(.{{{n}}})\1{{3,}}") for n in (2, 3, 4)]
PAIR = re.compile(ITEM_PAIR)


def name_key(name: str) -> str:
    plain = unicodedata.normalize("NFD", name.translate({ord("đ"): "d", ord("Đ"): "D"}))
    plain = "".join(c for c in plain if unicodedata.category(c) != "Mn").lower()
    return " ".join(re.sub(r"[^\w\s]+", " ", plain).split())


def cycle(keys: list[tuple[str, str]], max_period: int = MAX_PERIOD, single: int = SINGLE_REPEATS, several: int = CYCLE_REPEATS) -> tuple[int, int, str] | None:
    """(period, repeats, name) of the strongest cycle: most repeats, then the shorter, then the earlier."""
    found = []
    for p in range(1, max_period + 1):
        same = "".join("1" if k >= p and keys[k][0] and keys[k] == keys[k - p] else "0" for k in range(len(keys)))
        for run in re.finditer("1+", same):
            repeats, seed = (run.end() - run.start()) // p + 1, keys[run.start() - p : run.start()]
            if repeats >= (single if p == 1 else several) and (p == 1 or len(set(seed)) > 1):
                found.append((-repeats, p, run.start(), seed[0][0]))
    if not found:
        return None
    repeats, p, _, name = min(found)
    return p, -repeats, name


def loop_in(text: str) -> str | None:
    """What loop a text that is still being written shows, or None; cheap signs first."""
    if hit := RUN.search(text):
        return f"char_run match={hit[0]!r}"
    for pattern in NGRAMS:
        for hit in pattern.finditer(text):
            if not hit[1].isdigit() and not set(hit[1]) <= set(STRUCTURE):
                return f"ngram_loop match={hit[0]!r}"
    pairs = PAIR.findall(text)[-2 * max(SINGLE_REPEATS, MAX_PERIOD * CYCLE_REPEATS) :]
    hit = cycle([(name_key(n), "" if t == "null" else str(float(t))) for n, t in pairs])
    return f"{'dup_items_run' if hit[0] == 1 else 'cyclic_items'} period={hit[0]} repeats={hit[1]} name={hit[2]!r}" if hit else None


def loop_since(held: str, delta: str, every: int, tail: int) -> str | None:
    """What loop held + delta shows, where delta is new and of any length.

    A text within tail is checked as it is; a long delta also in pieces of `every`
    characters, each with the tail before it, so that its earlier parts are seen.
    """
    text = held + delta
    if len(text) <= tail or len(delta) <= every:
        if (reason := loop_in(text[-tail:])) or len(delta) <= every:
            return reason
    for end in range(len(held) + every, len(text) + every, every):
        if reason := loop_in(text[max(0, min(end, len(text)) - tail) : end]):
            return reason
    return None


def written(pieces: Iterable[str], every: int = EVERY, tail: int = TAIL) -> dict:
    """raw_text and finish_reason of a text that comes in pieces: hallu_abort where it loops, and no more of it is read.

    A text is checked each time it has grown by `every` characters, and at its end.
    """
    text, checked = "", 0
    for piece in pieces:
        text += piece
        if len(text) - checked >= every:
            if loop_since(text[max(0, checked - tail) : checked], text[checked:], every, tail):
                return {"raw_text": text, "finish_reason": "hallu_abort"}
            checked = len(text)
    looped = len(text) > checked and loop_since(text[max(0, checked - tail) : checked], text[checked:], every, tail)
    return {"raw_text": text, "finish_reason": "hallu_abort" if looped else "stop"}


OUTPUT = "ref string, chars long, reason string"
STATE = "tail string, chars long, checked long, reason string"


def check_stream(deltas: DataFrame, every: int = EVERY, tail: int = TAIL, timeout_ms: int | None = 300_000) -> DataFrame:
    """(ref, chars, reason) when a reference's text first loops or when it is abandoned (reason timeout).

    deltas: a stream of (ref, seq, delta) and, where the end of a text is known,
    finish_reason. A text is checked each time it has grown by `every` characters since
    the last check, and when it ends; of texts only the last `tail` characters are kept,
    so state is bounded, and it goes when a text ends. Nothing more is said of a reference
    that looped. With timeout_ms None nothing is abandoned, and the state of texts without
    an end stays; with one, a query over a finished source runs on until the last timeout.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, chars, checked, reason = state.get if state.exists else ("", 0, 0, None)
        if state.hasTimedOut:
            state.remove()
            if reason is None:
                yield pd.DataFrame([(key[0], chars, (chars > checked and loop_in(held)) or "timeout")], columns=["ref", "chars", "reason"])
            return
        said = reason
        parts = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for delta in parts["delta"]:
            if reason is not None or not delta:
                continue
            chars += len(delta)
            if chars - checked >= every:
                checked, reason = chars, loop_since(held, delta, every, max(tail, every))
            held = (held + delta)[-max(tail, every) :]
        if "finish_reason" in parts and parts["finish_reason"].notna().any():
            reason = reason or (loop_in(held) if chars > checked else None)
            if state.exists:
                state.remove()
        else:
            state.update(("" if reason else held, chars, checked, reason))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        if reason is not None and said is None:
            yield pd.DataFrame([(key[0], chars, reason)], columns=["ref", "chars", "reason"])

    return deltas.groupBy("ref").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def check_batch(deltas: DataFrame, every: int = EVERY, tail: int = TAIL) -> DataFrame:
    """The same over a table of whole texts' deltas: (ref, chars, reason) of each reference that loops.

    Rows of a reference are streamed in order; memory holds one tail.
    """

    def run(batches):
        now, held, chars, checked, reason = object(), "", 0, 0, None

        def ended() -> list:
            """What the end of a text shows that was not yet checked."""
            last = loop_in(held) if reason is None and chars > checked else None
            return [(now, chars, last)] if last else []

        for pdf in batches:
            out = []
            for ref, delta in zip(pdf["ref"], pdf["delta"]):
                if ref != now:
                    out += ended()
                    now, held, chars, checked, reason = ref, "", 0, 0, None
                if reason is None and delta:
                    chars += len(delta)
                    if chars - checked >= every:
                        checked, reason = chars, loop_since(held, delta, every, max(tail, every))
                        if reason:
                            out.append((ref, chars, reason))
                    held = (held + delta)[-max(tail, every) :]
            yield pd.DataFrame(out, columns=["ref", "chars", "reason"])
        yield pd.DataFrame(ended(), columns=["ref", "chars", "reason"])

    return deltas.repartition("ref").sortWithinPartitions("ref", "seq").mapInPandas(run, OUTPUT)


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums by event type, with a watermark: a Spark extension for event tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
