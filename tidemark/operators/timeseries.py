"""Daily series per property: gaps, anomalies, drift and alignment.

A series has one row per property and day of the current period; its length is bounded by the
window, which is what makes an exact median over a property safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import WEB_SPIKE_Z
from ..functions.dates import day_group
from ..functions.nulls import rnd, safe_div


def long_series(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """property_id, date, metric, value; days that did not report the metric drop out."""
    rows = ", ".join(f"struct('{m}' AS metric, CAST({m} AS DOUBLE) AS value)" for m in metrics)
    return daily.selectExpr("property_id", "date", f"inline(array({rows}))").filter(
        "value IS NOT NULL")


def with_robust_centre(series: DataFrame, groups: list[str]) -> DataFrame:
    """Median, median absolute deviation and count of each group, on every row."""
    w = Window.partitionBy(*groups)
    centred = series.withColumns({"median": F.median("value").over(w), "n": F.count("*").over(w)})
    return centred.withColumn("mad", F.median(F.abs(F.col("value") - F.col("median"))).over(w))


def web_anomalies(daily: DataFrame, metrics: list[str]) -> DataFrame:
    """Days with a robust z-score of 3.5 or more, in series of at least ten values."""
    centred = with_robust_centre(long_series(daily, metrics), ["property_id", "metric"])
    scored = centred.filter("n >= 10 AND mad <> 0").withColumn(
        "raw_z", F.expr("0.6745D * (value - median) / mad"))
    return scored.filter(F.abs("raw_z") >= WEB_SPIKE_Z).select(
        "property_id", "date", "metric", "value", "median", rnd(F.col("raw_z"), 2).alias("z"),
        F.when(F.col("raw_z") > 0, "spike").otherwise("drop").alias("direction"),
    )


def search_anomalies(daily: DataFrame) -> DataFrame:
    """Days off their weekday or weekend group by 4 MAD, 30 % and an absolute floor.

    Clicks and impressions moving on the same day raise the confidence.
    """
    series = long_series(daily, ["clicks", "impressions"]).withColumn(
        "day_kind", day_group(F.col("date")))
    centred = with_robust_centre(series, ["property_id", "metric", "day_kind"])
    off = centred.filter("n >= 6 AND median <> 0 AND mad <> 0").withColumn(
        "deviation", F.expr("value - median")
    ).filter(
        "abs(deviation) >= greatest(if(metric = 'clicks', 10.0D, 100.0D), median * 0.3D) "
        "AND abs(deviation) >= 4 * mad")
    both = F.count("*").over(Window.partitionBy("property_id", "date"))
    return off.select(
        "property_id", "date", "metric", "value", "day_kind",
        rnd(F.col("median"), 0).alias("typical"), rnd(F.col("deviation"), 0).alias("deviation"),
        rnd(F.expr("deviation / median * 100.0D"), 1).alias("deviation_pct"),
        F.when(F.col("deviation") > 0, "spike").otherwise("drop").alias("kind"),
        F.when(both > 1, "high").otherwise("medium").alias("confidence"),
    )


def missing_days(calendar: DataFrame, daily: DataFrame) -> DataFrame:
    """Calendar days of the current period without a row. A missing day is not a zero day."""
    return calendar.filter("period = 'current'").join(
        daily.select("property_id", "date"), ["property_id", "date"], "left_anti"
    ).select("property_id", "date")


def on_calendar(calendar: DataFrame, daily: DataFrame) -> DataFrame:
    """Every calendar day with its figures and whether the source returned it."""
    return calendar.join(
        daily.withColumn("returned", F.lit(True)), ["property_id", "period", "date"], "left"
    ).withColumn("returned", F.coalesce("returned", F.lit(False)))


def _halves(daily: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("property_id")
    return daily.filter(F.col(value).isNotNull()).select(
        "property_id", F.col(value).cast("double").alias("v"),
        F.row_number().over(w.orderBy("date")).alias("rn"), F.count("*").over(w).alias("n"),
    ).filter("n >= 14").withColumn("half", F.expr("n div 2"))


def drift(daily: DataFrame, value: str = "sessions") -> DataFrame:
    """Mean of the second half over the first, minus one; an odd day goes to the second half."""
    halves = _halves(daily, value).groupBy("property_id").agg(
        safe_div(F.sum(F.expr("if(rn <= half, v, null)")),
                 F.count_if(F.expr("rn <= half"))).alias("first"),
        safe_div(F.sum(F.expr("if(rn > half, v, null)")),
                 F.count_if(F.expr("rn > half"))).alias("second"),
    )
    return halves.filter("first <> 0").select(
        "property_id", F.expr("second / first - 1").alias("drift"))


def shape(daily: DataFrame, value: str = "clicks") -> DataFrame:
    """Sum of the last half against the first; the middle day of an odd count is left out."""
    halves = _halves(daily, value).groupBy("property_id").agg(
        F.sum(F.expr("if(rn <= half, v, null)")).alias("first_half"),
        F.sum(F.expr("if(rn > n - half, v, null)")).alias("second_half"),
    )
    changed = halves.withColumn("raw", F.expr(
        "try_divide(second_half - first_half, abs(first_half)) * 100.0D")).filter("raw IS NOT NULL")
    return changed.select(
        "property_id", "first_half", "second_half", rnd(F.col("raw"), 1).alias("change_pct"),
        F.expr("CASE WHEN abs(raw) < 10 THEN 'stable' WHEN raw > 0 THEN 'rising' "
               "ELSE 'falling' END").alias("trend"),
    )


def aligned(daily: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """Previous-period values under the same day number of the current period."""
    placed = calendar.join(daily, ["property_id", "period", "date"], "left")
    return placed.groupBy("property_id", "day_number").agg(
        F.max(F.when(F.col("period") == "current", F.col("date"))).alias("date"),
        F.max(F.when(F.col("period") == "current", F.col(value))).alias("current"),
        F.max(F.when(F.col("period") == "previous", F.col(value))).alias("previous"),
    ).filter("date IS NOT NULL")


# Daily ratios by KPI: numerator, denominator, in percent.
DAILY_RATIOS = {
    "cost_per_conversion": ("cost", "conversions", False),
    "roas": ("conversions_value", "cost", False),
    "ctr": ("clicks", "impressions", True),
    "conversion_rate": ("conversions", "clicks", True),
    "average_cpc": ("cost", "clicks", False),
    "engagementRate": ("engagedSessions", "sessions", True),
    "sessionKeyEventRate": ("keyEvents", "sessions", True),
}


def daily_series(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Series of the wanted KPIs: stored values first, else the ratio of two stored counts.

    A series needs at least three values; otherwise the property has none for that KPI.
    """
    rows = []
    for key in keys:
        options = []
        if key in daily.columns:
            options.append((1, f"CAST({key} AS DOUBLE)"))
        if key in DAILY_RATIOS:
            num, den, percent = DAILY_RATIOS[key]
            if num in daily.columns and den in daily.columns:
                ratio = f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"
                options.append((2, f"{ratio} * 100.0D" if percent else ratio))
        rows += [f"struct('{key}' AS metric, {rank} AS choice, {sql} AS value)"
                 for rank, sql in options]
    long = daily.selectExpr("property_id", "date", f"inline(array({', '.join(rows)}))")
    per = Window.partitionBy("property_id", "metric", "choice")
    enough = long.withColumn("n", F.count("value").over(per)).filter("n >= 3")
    best = F.min("choice").over(Window.partitionBy("property_id", "metric"))
    return enough.withColumn("best", best).filter("choice = best").select(
        "property_id", "metric", "date", "value")


def sparkline(series: DataFrame, width: float = 158.0, height: float = 26.0) -> DataFrame:
    """Coordinates of a trend line; a flat series stays at mid height."""
    w = Window.partitionBy("property_id", "metric")
    scaled = series.filter("value IS NOT NULL").withColumns({
        "n": F.count("*").over(w), "lo": F.min("value").over(w), "hi": F.max("value").over(w),
        "i": F.row_number().over(w.orderBy("date")) - 1,
    }).filter("n >= 3")
    inner = height - 6.0
    return scaled.selectExpr(
        "property_id", "metric", "date",
        f"1.0D + i * (({width}D - 2.0D) / (n - 1)) AS x",
        f"CASE WHEN hi = lo THEN {height / 2}D "
        f"ELSE 3.0D + {inner}D - ((value - lo) / (hi - lo)) * {inner}D END AS y",
    )


def flatten_layouts(flat: DataFrame | None, nested: DataFrame | None, metrics: list[str]) -> DataFrame:
    """Two daily layouts as one: plain columns, or a `values` map keyed by metric."""
    parts = []
    if flat is not None:
        parts.append(flat.select("property_id", "date", *[
            F.col(m).cast("double").alias(m) for m in metrics if m in flat.columns]))
    if nested is not None:
        parts.append(nested.select("property_id", "date", *[
            F.try_element_at("values", F.lit(m)).cast("double").alias(m) for m in metrics]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(
        parts[1], allowMissingColumns=True)
