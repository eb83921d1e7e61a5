"""The event log as a stream: cursor reads, replay, idempotence, lifecycle state (STM1-3, STM5-6, STM8, STM10, ORD3-4, ORD9, FLT18, SNK7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Prefixes and whole names of event types by timeline category (fixed values); ALL takes every event.
CATEGORIES = {
    "STAGES": (["STAGE_", "SCAN_", "TOOL_"], []),
    "FINDINGS": ([], ["FINDING_CONFIRMED"]),
    "PATCHES": (["PATCH_"], []),
    "HUMAN_AUDIT": (["HUMAN_"], ["PATCH_APPROVED", "PATCH_REJECTED", "PATCH_REVISION_CREATED"]),
    "DELIVERIES": (["DELIVERY_"], []),
}
TERMINAL = ["COMPLETED", "FAILED"]


def cursor(last_event_id: Column, after_id: Column) -> Column:
    """STM5: Last-Event-ID if there is one (null where it is no number), else after_id, 0 at least."""
    return F.when(last_event_id.isNotNull(), F.try_to_number(F.trim(last_event_id), F.lit("999999999999999999")).cast("long")).otherwise(F.greatest(F.coalesce(after_id, F.lit(0)), F.lit(0)).cast("long"))


def tail(events: DataFrame, after: int, limit: int = 100, id_col: str = "id") -> DataFrame:
    """STM1, ORD3: the next events after a cursor, in order."""
    return events.where(F.col(id_col) > after).orderBy(id_col).limit(limit)


def in_category(event_type: Column, category: str) -> Column:
    """FLT18: whether an event belongs to a timeline category; to ALL and to unknown ones every event does."""
    prefixes, names = CATEGORIES.get(category, ([""], []))
    hit = event_type.isin(names) if names else F.lit(False)
    for p in prefixes:
        hit = hit | event_type.startswith(p)
    return hit


def read(spark: SparkSession, path: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """STM2: a folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).parquet(path)


def after_cursor(stream: DataFrame, after: int, id_col: str = "id", time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """STM1, STM6: events after a cursor, each id once.

    With time_col, an id is remembered for `late` behind the newest event, and older events are dropped as late; without, for ever.
    """
    own = stream.where(F.col(id_col) > after)
    return own.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col]) if time_col else own.dropDuplicates([id_col])


def client_list(events: DataFrame, id_col: str = "id") -> DataFrame:
    """ORD9: a client's list of events: each id once, the row that came first by its columns, in order."""
    other = [c for c in events.columns if c != id_col]
    one = events.groupBy(id_col).agg(F.min(F.struct(*other)).alias("e")) if other else events.distinct()
    return one.select(id_col, *[F.col("e")[c].alias(c) for c in other]).orderBy(id_col)


def finished(scans: DataFrame, events: DataFrame, cursors: DataFrame) -> DataFrame:
    """STM3: scan_id, done: a scan's stream ends when it is terminal and nothing stands behind its cursor.

    scans: id, status. cursors: scan_id, after. A scan without a cursor has read nothing.
    """
    last = events.groupBy("scan_id").agg(F.max("id").alias("last"))
    s = scans.select(F.col("id").alias("scan_id"), "status").join(last, "scan_id", "left").join(cursors, "scan_id", "left")
    return s.select("scan_id", (F.col("status").isin(TERMINAL) & (F.coalesce("last", F.lit(0)) <= F.coalesce("after", F.lit(0)))).alias("done"))


def latest_state(events: DataFrame, key: str, status: Column, id_col: str = "id") -> DataFrame:
    """STM10 in batch: the last status of each key by id."""
    return events.groupBy(key).agg(F.max_by(status, id_col).alias("status"), F.max(id_col).alias("last_id"))


def lifecycle(stream: DataFrame, key: str, status_col: str, id_col: str = "id") -> DataFrame:
    """STM10 as a stream: key, status, last_id in update mode; an event not after the last one seen changes nothing."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status = state.get if state.exists else (-1, None)
        for f in frames:
            f = f[f[id_col] > last].sort_values(id_col)
            if len(f):
                last, status = int(f[id_col].iloc[-1]), str(f[status_col].iloc[-1])
        state.update((last, status))
        yield pd.DataFrame({key: [k[0]], "status": [status], "last_id": [last]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, last_id long", "last_id long, status string", "update", GroupStateTimeout.NoTimeout)


def unfinished(scans: DataFrame) -> DataFrame:
    """STM8, ORD4: scans to take up again, oldest first."""
    return scans.where(F.col("status").isin("PENDING", "RUNNING")).orderBy("created_at", "id")


def frames(events: DataFrame) -> DataFrame:
    """SNK7: server-sent events, in order."""
    from codequarry.functions.text import event_frame

    return events.orderBy("id").select("id", event_frame(F.col("id"), F.col("event_type"), F.to_json(F.struct(*events.columns))).alias("frame"))
