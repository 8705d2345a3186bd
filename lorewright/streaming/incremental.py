"""Structured Streaming twins of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorewright.plans.project import analyze

_OUT = "key bigint, previous string, state string, events bigint, at timestamp_ntz"
_STATE = "state string, events bigint, at timestamp_ntz"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, n, at = held.get if held.exists else (None, 0, None)
    rows = pd.concat(batches).sort_values(["ts", "event_id"])
    out = []
    for ts, event in zip(rows["ts"], rows["event_type"]):
        if at is not None and ts < at:  # a late event counts but doesn't turn the state back
            n += 1
            continue
        n += 1
        if event != state:
            out.append((key[0], state, event, n, ts))
        state, at = event, ts
    held.update((state, n, at))
    yield pd.DataFrame(out, columns=["key", "previous", "state", "events", "at"])


def transitions(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Changes of state per key as events arrive; the state per key is three fields."""
    return events.withColumn("_key", F.col(key)).groupBy("_key").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts per hour and type; state of hours older than the watermark is dropped."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def analyze_arriving(chapters: DataFrame, target: str, checkpoint: str, **kw):
    """K3, K4: chapters are analysed as they arrive; a batch that is run again overwrites its own partitions, so a restart repeats nothing.

    chapters: book_id, chapter, text of whole books per batch, or of books whose cast starts anew.
    """

    def batch(df: DataFrame, _: int) -> None:
        out = analyze(df, **kw)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter").parquet(target)

    return chapters.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
