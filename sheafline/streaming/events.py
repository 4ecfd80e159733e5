"""Roll-ups by event time whose state a watermark clears: repeated requests and sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.shipping import ship

ship(__name__)


def first_requests(requests: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """requests without those that repeat the key of one that was kept less than `within` before.

    A stream keeps a key for so long in its state, in which the order of arrival counts; a
    table goes by time, rows of one time in any order. Rows without a time are dropped, as
    no watermark can place them. A null key is a key of its own.
    """
    if requests.isStreaming:
        return requests.where(F.col(ts).isNotNull()).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    span = pd.Timedelta(within)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by key and time; one key and time is held."""
        now, last = None, None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key], pdf[ts]):
                k = None if pd.isna(k) else k
                kept = last is None or k != now or t >= last + span
                now, last = (k, t) if kept else (now, last)
                keep.append(kept)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    # A key's rows are one task's, streamed: what comes next depends on what was kept.
    timed = requests.where(F.col(ts).isNotNull())
    return timed.repartition(key).sortWithinPartitions(key, ts).mapInPandas(walk, timed.schema)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Stretches of a key's events with less than `gap` between them: key, start, end (of the last event's gap), n, total."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")
