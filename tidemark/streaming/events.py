"""Event streams: days that are final, engaged sessions and event life cycles."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def finalised_days(events: DataFrame, settle: str = "2 days") -> DataFrame:
    """Daily counts per property and event, emitted once a day can no longer change.

    The watermark is the settling time: a day comes out when it lies that far behind the newest
    event, and later rows for it are dropped. State holds one row per property, event and open day.
    """
    stamped = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    return (
        stamped.withWatermark("event_time", settle)
        .groupBy(F.window("event_time", "1 day"), "property_id", "event_name")
        .agg(F.count("*").alias("event_count"), F.count_if("is_key").alias("key_events"),
             F.sum("revenue").alias("revenue"))
        .select(F.to_date("window.start").alias("date"), "property_id", "event_name",
                "event_count", "key_events", "revenue")
    )


def engaged_sessions(events: DataFrame, gap: str = "30 minutes", settle: str = "1 hour") -> DataFrame:
    """Sessions per user, closed by the gap, with the engagement rule of the batch operator."""
    stamped = events.withColumn("event_time", F.col("ts").cast("timestamp"))
    sessions = (
        stamped.withWatermark("event_time", settle)
        .groupBy(F.session_window("event_time", gap).alias("w"), "property_id", "user_id")
        .agg(F.min("event_time").alias("started"), F.max("event_time").alias("ended"),
             F.count("*").alias("events"), F.count_if("is_key").alias("key_events"),
             F.count_if(F.col("event_name") == "view").alias("views"))
    )
    return sessions.select(
        "property_id", "user_id", "started", "ended", "events", "key_events", "views",
        F.expr("unix_micros(ended) - unix_micros(started) > 10000000 OR key_events > 0 "
               "OR views >= 2").alias("engaged"))


def event_life(daily: DataFrame, windows) -> DataFrame:
    """Counts of both windows per event from the table of final days, ready for the event rules."""
    from ..operators.periods import mark

    marked = mark(daily, windows)
    return marked.groupBy("property_id", "event_name").agg(
        F.expr("nullif(sum(if(in_current, event_count, 0)), 0)").alias("cur_eventCount"),
        F.expr("nullif(sum(if(in_previous, event_count, 0)), 0)").alias("prev_eventCount"),
        F.expr("sum(if(in_current, key_events, 0))").alias("cur_keyEvents"),
    )


CHANGES = "property_id string, event_name string, change string, date date, previous_date date, event_count bigint"
LIFE = "first_day date, last_day date, event_count bigint"


def _midnight(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)


def event_changes(days: DataFrame, quiet_days: int = 7, settle: str = "1 day") -> DataFrame:
    """When events start, stop and come back, as a stream of finalised days tells it.

    `days` is a stream of property_id, event_name, date and event_count, as `finalised_days` writes
    them. An event has started on its first day, has stopped once the stream is `quiet_days` past its last
    day, and is back when it has a day after that. `event_count` is the sum since it started or
    came back. State is three figures per event that has not stopped; a timer on event time ends it, so
    an event that stays away needs no further row to be reported. Rows that lie `settle` behind the
    newest day are late and dropped.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            first, last, count = state.get
            out.append((*key, "stopped", last + timedelta(days=quiet_days), last, count))
            state.remove()
        else:
            first, last, count = state.get if state.exists else (None, None, 0)
            rows = pd.concat(list(batches)).groupby("date")["event_count"].sum().sort_index()
            for day, n in rows.items():
                if last is not None and day > last + timedelta(days=quiet_days):
                    # The stream has moved on by more than the quiet time within one batch.
                    out.append((*key, "stopped", last + timedelta(days=quiet_days), last, count))
                    first, count = None, 0
                if first is None:
                    out.append((*key, "started", day, last, 0))
                    first = day
                last, count = max(day, last or day), count + int(n)
            state.update((first, last, count))
            # The day after the quiet time: until then a row of its last day may come.
            state.setTimeoutTimestamp(_midnight(last + timedelta(days=quiet_days + 1)))
        yield pd.DataFrame(out, columns=["property_id", "event_name", "change", "date", "previous_date", "event_count"])

    stamped = days.withColumn("event_time", F.col("date").cast("timestamp"))
    return stamped.withWatermark("event_time", settle).groupBy("property_id", "event_name").applyInPandasWithState(
        step, CHANGES, LIFE, "append", GroupStateTimeout.EventTimeTimeout)
