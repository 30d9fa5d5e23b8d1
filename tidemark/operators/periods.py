"""Comparison windows: two adjacent spans of days, per run or per property."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import FRESHNESS_LOOKBACK_DAYS, RETENTION_DAYS
from ..session import stage
from .aggregate import attach


@dataclass(frozen=True)
class Windows:
    """One pair of windows shared by every property; its bounds reach the scan as literals."""

    cur_start: date
    cur_end: date
    prev_start: date
    prev_end: date

    def __post_init__(self):
        for start, end in ((self.cur_start, self.cur_end), (self.prev_start, self.prev_end)):
            if end < start:
                raise ValueError(f"window ends before it starts ({start} to {end})")

    @property
    def cur_days(self) -> int:
        return (self.cur_end - self.cur_start).days + 1

    @property
    def prev_days(self) -> int:
        return (self.prev_end - self.prev_start).days + 1


def adjacent(end: date, days: int = 30, lag_days: int = 0) -> Windows:
    """`days` up to `end`, and the `days` before them, without gap or overlap."""
    cur_end = end - timedelta(days=lag_days)
    cur_start = cur_end - timedelta(days=days - 1)
    prev_end = cur_start - timedelta(days=1)
    return Windows(cur_start, cur_end, prev_end - timedelta(days=days - 1), prev_end)


def explicit(
    current: tuple[date, date],
    previous: tuple[date, date] | None = None,
    infer_previous: bool = False,
) -> Windows:
    """Windows as given. Only search may leave out the previous one and have it inferred."""
    if previous is None:
        if not infer_previous:
            raise ValueError("current and previous windows must be given together")
        if current[1] < current[0]:
            raise ValueError("window ends before it starts")
        span = (current[1] - current[0]).days + 1
        end = current[0] - timedelta(days=1)
        previous = (end - timedelta(days=span - 1), end)
    return Windows(current[0], current[1], previous[0], previous[1])


def today_in_zone(now_utc: Column, zone: Column) -> Column:
    """The account's own calendar day; without a zone the session's day (UTC)."""
    return F.to_date(F.from_utc_timestamp(now_utc, F.coalesce(zone, F.lit("UTC"))))


def period_frame(
    properties: DataFrame, days: int = 30, lag_days: int = 0, end_given: bool = False
) -> DataFrame:
    """Windows per property from a `today` column, or from `end_date` when that is given."""
    end = F.col("end_date") if end_given else F.date_sub(F.col("today"), 1 + lag_days)
    return (
        properties.withColumn("cur_end", end)
        .withColumn("cur_start", F.date_sub("cur_end", days - 1))
        .withColumn("prev_end", F.date_sub("cur_start", 1))
        .withColumn("prev_start", F.date_sub("prev_end", days - 1))
    )


def with_period_flags(periods: DataFrame) -> DataFrame:
    """Lengths and the warnings about them. `today` may be null."""
    cur_days = F.date_diff("cur_end", "cur_start") + 1
    prev_days = F.date_diff("prev_end", "prev_start") + 1
    return (
        periods.withColumn("cur_days", cur_days)
        .withColumn("prev_days", prev_days)
        .withColumn("reversed", (F.col("cur_end") < F.col("cur_start"))
                    | (F.col("prev_end") < F.col("prev_start")))
        .withColumn("comparable", F.col("cur_days") == F.col("prev_days"))
        .withColumn("overlapping", F.col("prev_end") >= F.col("cur_start"))
        .withColumn("partial_today", F.coalesce(F.col("cur_end") >= F.col("today"), F.lit(False)))
        .withColumn("beyond_retention",
                    F.coalesce(F.col("prev_start") < F.date_sub("today", RETENTION_DAYS),
                               F.lit(False)))
    )


def freshness(
    facts: DataFrame, today: Column, state: str = "state",
    lookback_days: int = FRESHNESS_LOOKBACK_DAYS,
) -> DataFrame:
    """Newest finalised day per property, how far it lags and how many provisional days follow.

    Facts are reduced to one row per property and day before anything is counted.
    """
    recent = facts.filter(
        (F.col("date") >= F.date_sub(today, lookback_days)) & (F.col("date") <= today)
    )
    daily = recent.groupBy("property_id", "date").agg(
        F.max(F.col(state) == "final").alias("has_final")
    )
    latest = daily.groupBy("property_id").agg(
        F.max(F.when(F.col("has_final"), F.col("date"))).alias("latest_final"),
        F.max("date").alias("latest_any"),
        F.count_if("has_final").alias("days_with_final"),
    )
    return (
        latest.withColumn("lag_days", F.date_diff(today, "latest_final"))
        .withColumn(
            "fresh_days",
            F.coalesce(F.greatest(F.date_diff("latest_any", "latest_final"), F.lit(0)), F.lit(0)),
        )
    )


def flag(facts: DataFrame, windows: Windows, on: str = "date") -> DataFrame:
    """Flag the rows of either window and keep the history around them."""
    day = F.col(on)
    return facts.withColumns({
        "in_current": day.between(F.lit(windows.cur_start), F.lit(windows.cur_end)),
        "in_previous": day.between(F.lit(windows.prev_start), F.lit(windows.prev_end)),
    })


def mark(facts: DataFrame, windows: Windows | DataFrame, on: str = "date") -> DataFrame:
    """Keep the rows of either window and flag which one they are in.

    Two flags rather than one label, because overlapping windows count a day twice. With one pair
    of windows the bounds are literals and are pushed into the scan. With a frame of windows per
    property, the outermost bounds are pushed down; the frame is written once and counted, then
    broadcast up to a million rows, and beyond that joined by a salted shuffle.
    """
    if isinstance(windows, Windows):
        flagged = flag(facts, windows, on)
        return flagged.filter("in_current OR in_previous")
    bounds = stage(
        windows.select("property_id", "cur_start", "cur_end", "prev_start", "prev_end"), "windows")
    outer = bounds.agg(
        F.least(F.min("cur_start"), F.min("prev_start")).alias("lo"),
        F.greatest(F.max("cur_end"), F.max("prev_end")).alias("hi")).first()
    rows = facts.filter(F.col(on).between(F.lit(outer["lo"]), F.lit(outer["hi"])))
    spread = [c for c, t in facts.dtypes if not t.startswith(("map", "struct", "array"))]
    joined = attach(rows, bounds, ["property_id"], spread, "inner")
    return joined.withColumns({
        "in_current": F.expr(f"{on} BETWEEN cur_start AND cur_end"),
        "in_previous": F.expr(f"{on} BETWEEN prev_start AND prev_end"),
    }).filter("in_current OR in_previous").drop("cur_start", "cur_end", "prev_start", "prev_end")


def calendar(windows: Windows | DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """Every day of both windows per property, gaps included, with its day number."""
    if isinstance(windows, Windows):
        frame = properties.select("property_id").withColumns({
            "cur_start": F.lit(windows.cur_start), "cur_end": F.lit(windows.cur_end),
            "prev_start": F.lit(windows.prev_start), "prev_end": F.lit(windows.prev_end),
        })
    else:
        frame = windows
    spans = F.array(
        F.struct(F.lit("current").alias("period"), F.col("cur_start").alias("s"),
                 F.col("cur_end").alias("e")),
        F.struct(F.lit("previous").alias("period"), F.col("prev_start").alias("s"),
                 F.col("prev_end").alias("e")),
    )
    return (
        frame.select("property_id", F.inline(spans))
        .select("property_id", "period", "s", F.explode(F.sequence("s", "e")).alias("date"))
        .withColumn("day_number", F.date_diff("date", "s"))
        .drop("s")
    )
