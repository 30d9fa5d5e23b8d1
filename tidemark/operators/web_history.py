"""When users were first seen and first bought, kept in tables that grow by finished days.

Whether a user is new is decided by all events there ever were. A report that asks the events again
reads the whole history each time. Here each finished day adds a few rows: its new users, the
first purchases, and the sessions that may go on past midnight. A report then reads the events of
its windows, and of the kept rows those of the windows too.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_days_after, stage, staging_scope
from .periods import Windows, flag
from .web import sessionize

USERS = "property_id string, user_id {user}, first_seen date, first_channel string, day date"
PURCHASES = "property_id string, user_id {user}, first_purchase date, day date"
OPEN = "property_id string, user_id {user}, open_date date, last_ts timestamp_ntz, day date"
KEY = ["property_id", "user_id"]


def _table(spark: SparkSession, path: str, name: str, schema: str, user: str) -> DataFrame:
    schema = schema.format(user=user)
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def kept_through(spark: SparkSession, path: str) -> date | None:
    """The last day that has been kept; nothing of a later one counts."""
    try:
        return spark.read.parquet(f"{path}/through").agg(F.max("through")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _user_type(events: DataFrame) -> str:
    return events.schema["user_id"].dataType.simpleString()


def keep(events: DataFrame, path: str, through: date, gap_minutes: int = 30) -> None:
    """Add the days after the last kept one up to `through`; these must be final.

    Only their events are read. A session that was open at the last midnight goes on with the day's first
    session if that starts within the gap, and keeps its date. What an earlier attempt wrote for these
    days is replaced; the days count once `through` is written, as the last step.
    """
    if gap_minutes >= 24 * 60:
        raise ValueError("a session may not be silent for a day")
    spark, user = events.sparkSession, _user_type(events)
    last = kept_through(spark, path)
    if last is not None and last >= through:
        return
    rows = events.filter(F.col("date") <= F.lit(through))
    if last is not None:
        rows = rows.filter(F.col("date") > F.lit(last))
    with staging_scope(spark):
        found = stage(sessionize(rows, gap_minutes).withColumns({
            c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")}), "kept-sessions")
        own = found.groupBy(*KEY).agg(
            F.min(F.struct("started", "ended", "date", "channel", "purchases")).alias("first"),
            F.max(F.struct("started", "ended", "date")).alias("last"), F.count("*").alias("sessions"))
        # Purchases of all but the first session of the user, which may belong to an earlier day.
        later = found.filter("purchases > 0").join(own.select(*KEY, "first.started").withColumnRenamed("started", "_first"), KEY).filter(
            "started > _first").groupBy(*KEY).agg(F.min(F.struct("date", "started")).alias("bought"))
        before = _table(spark, path, "open", OPEN, user).filter(F.col("day") == F.lit(last)).drop("day") if last else None
        own = own.join(later, KEY, "left")
        own = own.join(before, KEY, "left") if before is not None else own.withColumns({
            "open_date": F.lit(None).cast("date"), "last_ts": F.lit(None).cast("timestamp_ntz")})
        goes_on = F.expr(f"coalesce(first.started <= last_ts + INTERVAL '{gap_minutes}' MINUTE, false)")
        own = stage(own.withColumn("_on", goes_on), "kept-users")
        known = _table(spark, path, "users", USERS, user).filter(F.col("day") <= F.lit(last)) if last else None
        fresh = own if known is None else own.join(known.select(*KEY), KEY, "left_anti")
        users = fresh.select(*KEY, F.col("first.date").alias("first_seen"), F.col("first.channel").alias("first_channel"), F.col("first.date").alias("day"))
        first_day = F.expr("CASE WHEN first.purchases > 0 THEN IF(_on, open_date, first.date) END")
        day = F.expr("CAST(CASE WHEN first.purchases > 0 THEN first.started ELSE bought.started END AS DATE)")
        purchases = own.select(*KEY, F.least(first_day, "bought.date").alias("first_purchase"), day.alias("day")).filter("first_purchase IS NOT NULL")
        if last:
            purchases = purchases.join(
                _table(spark, path, "purchases", PURCHASES, user).filter(F.col("day") <= F.lit(last)).select(*KEY), KEY, "left_anti")
        # Sessions whose next event could still come within the gap after midnight.
        end = F.expr(f"TIMESTAMP_NTZ '{through + timedelta(days=1)} 00:00:00' - INTERVAL '{gap_minutes}' MINUTE")
        still = own.select(*KEY, F.expr("IF(_on AND sessions = 1, open_date, last.date)").alias("open_date"),
                           F.col("last.ended").alias("last_ts"), F.lit(through).alias("day")).filter(F.col("last_ts") >= end)
        for name, part in (("users", users), ("purchases", purchases), ("open", still)):
            remove_days_after(spark, f"{path}/{name}", last)
            part.write.mode("append").partitionBy("day").parquet(f"{path}/{name}")
        spark.createDataFrame([(through,)], "through date").coalesce(1).write.mode("append").parquet(f"{path}/through")


def windowed_sessions(
    events: DataFrame, windows: Windows, path: str, gap_minutes: int = 30, dimensions: tuple[str, ...] = (),
    first_channel: bool = True,
) -> DataFrame:
    """Flagged sessions of both windows, with first_seen, first_purchase and first_channel of the user.

    Events are read from one gap before the windows, which tells a session that goes on from one that
    starts, to a day after them. If a session of the windows is still going on there, the reach is
    doubled until none is. first_seen and first_purchase are given where they lie in the windows and
    are null otherwise. Without `first_channel` only kept rows of the windows are read.
    """
    spark, user = events.sparkSession, _user_type(events)
    lo, hi = min(windows.cur_start, windows.prev_start), max(windows.cur_end, windows.prev_end)
    if (last := kept_through(spark, path)) is None or last < hi:
        raise ValueError(f"first-seen tables are kept through {last}, the windows end on {hi}")
    # Literals of the column's own type reach the scan.
    kind = events.schema["ts"].dataType.typeName().upper()
    reach = 1
    while True:
        stop = hi + timedelta(days=reach)
        rows = events.filter(F.col("date").between(F.lit(lo - timedelta(days=1)), F.lit(stop))).filter(
            f"ts >= {kind} '{lo} 00:00:00' - INTERVAL '{gap_minutes}' MINUTE AND ts < {kind} '{stop + timedelta(days=1)} 00:00:00'")
        found = flag(sessionize(rows, gap_minutes, dimensions), windows).filter("in_current OR in_previous")
        found = stage(found, "window-sessions")
        end = F.expr(f"TIMESTAMP_NTZ '{stop + timedelta(days=1)} 00:00:00' - INTERVAL '{gap_minutes}' MINUTE")
        if found.filter(F.col("ended").cast("timestamp_ntz") >= end).isEmpty():
            break
        reach *= 2
    # One row per user on the kept side: a user with very many sessions is split by adaptive execution.
    users = _table(spark, path, "users", USERS, user).filter(F.col("day") <= F.lit(hi))
    if not first_channel:
        users = users.filter(F.col("day") >= F.lit(lo))
    kept = _table(spark, path, "purchases", PURCHASES, user)
    bought = kept.filter((F.col("day") >= F.lit(lo)) & F.col("first_purchase").between(F.lit(lo), F.lit(hi))).drop("day")
    # A session of the windows may go on past the last kept day and buy there, for the first time.
    late = found.filter((F.col("purchases") > 0) & (F.col("ended").cast("date") > F.lit(last))).groupBy(*KEY).agg(F.min("date").alias("first_purchase"))
    if not late.isEmpty():
        bought = bought.unionByName(late.join(kept.select(*KEY), KEY, "left_anti"))
    return found.join(users.drop("day"), KEY, "left").join(bought, KEY, "left")
