"""Data-quality checks as rows: property_id, check, status and detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import (
    ADS_SMALL_CONVERSIONS, ADS_SPARSE_CLICKS, SEARCH_SMALL_CLICKS, WEB_MIN_SESSIONS, Kpi,
)
from ..functions.compare import long_kpis
from ..functions.display import grouped
from .periods import Windows


def check(name: str, status: str, detail: str = "''") -> str:
    """SQL text; a null status leaves the check out."""
    return (f"CASE WHEN ({status}) IS NOT NULL THEN struct('{name}' AS check, ({status}) AS status, "
            f"CAST({detail} AS STRING) AS detail) END")


def run_checks(df: DataFrame, checks: list[str]) -> DataFrame:
    return df.selectExpr("property_id", f"inline(array_compact(array({', '.join(checks)})))")


def period_check(windows: Windows) -> str:
    same = windows.cur_days == windows.prev_days
    return check("equal periods", f"'{'pass' if same else 'fail'}'",
                 f"'{windows.cur_days} days vs {windows.prev_days} days'")


def ads_checks(
    kpis: DataFrame, totals: DataFrame, campaigns: DataFrame, daily: DataFrame,
    coverage: DataFrame, windows: Windows,
) -> DataFrame:
    """Periods, spend reconciliation, daily coverage, share coverage and sample size."""
    sums = campaigns.groupBy("property_id").agg(
        F.sum("cur_cost").alias("cur_campaigns"), F.sum("prev_cost").alias("prev_campaigns"),
        F.count_if(F.col("cur_clicks") < ADS_SPARSE_CLICKS).alias("sparse"))
    days = daily.groupBy("property_id").agg(
        F.count_distinct(F.expr("if(period = 'current', date, null)")).alias("cur_returned"),
        F.count_distinct(F.expr("if(period = 'previous', date, null)")).alias("prev_returned"))
    joined = (
        kpis.select("property_id", "k_conversions")
        .join(totals.select("property_id", "cur_cost", "prev_cost"), "property_id")
        .join(sums, "property_id", "left").join(days, "property_id", "left")
        .join(coverage.select("property_id", "share_of_impressions", "campaigns_reporting"),
              "property_id", "left")
    )

    def reconciles(p: str) -> str:
        gap = f"abs({p}_campaigns - {p}_cost)"
        return (f"CASE WHEN {gap} <= greatest(0.01, {p}_cost * 0.005) THEN 'pass' "
                f"WHEN {gap} IS NOT NULL THEN 'fail' END")

    def covered(p: str, wanted: int) -> str:
        return f"CASE WHEN {p}_returned > 0 AND {p}_returned < {wanted} THEN 'fail' END"

    return run_checks(joined, [
        period_check(windows),
        check("campaign spend reconciles (current)", reconciles("cur")),
        check("campaign spend reconciles (previous)", reconciles("prev")),
        check("daily coverage (current)", covered("cur", windows.cur_days),
              f"concat(cur_returned, ' of {windows.cur_days} days')"),
        check("daily coverage (previous)", covered("prev", windows.prev_days),
              f"concat(prev_returned, ' of {windows.prev_days} days')"),
        check("impression share coverage",
              "CASE WHEN share_of_impressions < 90 AND campaigns_reporting > 0 THEN 'warn' END",
              f"concat({grouped('share_of_impressions', 0)}, '% of impressions')"),
        check("campaigns too small", "CASE WHEN sparse > 0 THEN 'warn' END",
              "concat(sparse, ' campaigns')"),
        check("account sample size",
              f"CASE WHEN k_conversions.current < {ADS_SMALL_CONVERSIONS} THEN 'warn' END",
              f"concat({grouped('k_conversions.current', 1)}, ' conversions')"),
    ])


def unavailable_metrics(kpis: DataFrame, specs: list[Kpi]) -> DataFrame:
    """KPIs that one or both periods did not report, with the reason."""
    rows = long_kpis(kpis, specs, ["property_id"]).filter("availability <> 'available'")
    return rows.selectExpr(
        "property_id", "key", "label",
        "CASE WHEN availability = 'unavailable' THEN 'not reported for either period' "
        "WHEN current IS NOT NULL THEN 'available for the current period only' "
        "ELSE 'available for the previous period only' END AS reason")


def account_checks(accounts: DataFrame) -> DataFrame:
    """Test accounts, manager accounts and accounts that are not live."""
    return run_checks(accounts, [
        check("test account", "CASE WHEN is_test_account THEN 'fail' END"),
        check("manager account", "CASE WHEN is_manager THEN 'fail' END"),
        check("account status", "CASE WHEN status <> '' AND status NOT IN "
              "('ENABLED', 'UNSPECIFIED', 'UNKNOWN') THEN 'warn' END", "status"),
    ])


def dataset_checks(status: DataFrame) -> DataFrame:
    """A failed dataset is unavailable and not empty."""
    return status.selectExpr(
        "property_id", "concat(dataset, ' (', period, ')') AS check",
        "CASE status WHEN 'failed' THEN 'fail' WHEN 'empty' THEN 'info' ELSE 'pass' END AS status",
        "CASE status WHEN 'failed' THEN 'unavailable, not empty' WHEN 'empty' THEN 'asked, nothing there' "
        "ELSE 'rows returned' END AS detail")


def source_caveats(reports: DataFrame) -> DataFrame:
    """What the source says about its own figures: caps, folded rows, thresholds, sampling.

    `reports` has property_id, dataset, period, row_count, row_limit and the meta flags.
    """
    texts = {
        "row_limit > 1 AND row_count >= row_limit": "row cap reached",
        "data_loss": "rows folded into (other)",
        "thresholding": "rows withheld by thresholding",
        "empty_reason IS NOT NULL": "empty with a reason",
        "sampled": "sampled figures",
    }
    array = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for cond, text in texts.items())
    return reports.selectExpr("property_id", "dataset", "period",
                              f"explode(array_compact(array({array}))) AS caveat")


def web_checks(
    kpis: DataFrame, missing: DataFrame, windows: Windows, min_sessions: int = WEB_MIN_SESSIONS
) -> DataFrame:
    """Baseline, volume, key events, the engagement complement, gaps and ecommerce."""
    gaps = missing.groupBy("property_id").agg(F.count("*").alias("gap_days"))
    joined = kpis.join(gaps, "property_id", "left")
    key = "k_keyEvents"
    return run_checks(joined, [
        period_check(windows),
        check("comparison period has data", "if(baseline_empty, 'warn', 'pass')"),
        check("enough traffic",
              "CASE WHEN k_sessions.availability <> 'available' THEN 'fail' "
              f"WHEN k_sessions.current < {min_sessions * 10} THEN 'warn' ELSE 'pass' END",
              grouped("k_sessions.current", 0)),
        check("key events recorded",
              f"CASE WHEN {key}.availability = 'unavailable' THEN 'fail' "
              f"WHEN coalesce({key}.current, 0) = 0 AND coalesce({key}.previous, 0) = 0 "
              "THEN 'warn' ELSE 'pass' END"),
        check("engagement and bounce sum to 100",
              "CASE WHEN abs(k_engagementRate.current + k_bounceRate.current - 100) < 0.5 "
              "AND k_engagementRate.availability = 'available' THEN 'pass' END"),
        check("continuous daily collection", "if(gap_days > 0, 'fail', 'pass')",
              "coalesce(gap_days, 0)"),
        check("ecommerce data", "CASE ecommerce_state WHEN 'active' THEN 'pass' "
              "WHEN 'no_data' THEN 'info' ELSE 'warn' END", "ecommerce_state"),
    ])


def definition_checks(properties: DataFrame) -> DataFrame:
    """Key-event definitions and property schema; `definitions` and `metadata_loaded` columns."""
    return run_checks(properties, [
        check("key event definitions readable",
              "CASE WHEN definitions IS NULL THEN 'warn' WHEN size(definitions) = 0 THEN 'warn' "
              "ELSE 'pass' END", "coalesce(size(definitions), 0)"),
        check("property schema loaded", "if(coalesce(metadata_loaded, false), 'pass', 'warn')"),
    ])


def search_checks(
    kpis: DataFrame, freshness: DataFrame, coverage: DataFrame, brands: DataFrame,
    windows: Windows, data_state: str = "final", appearances: DataFrame | None = None,
) -> DataFrame:
    """Finalised data, coverage of each dimension, sample size, baselines and skipped splits.

    `coverage` is long: property_id, dimension, coverage_pct. `brands` has one row per property
    with configured terms, `appearances` the properties with rows by search appearance.
    """
    wide = coverage.groupBy("property_id").agg(*[
        F.max(F.expr(f"if(dimension = '{d}', coverage_pct, null)")).alias(f"{d}_coverage")
        for d in ("query", "page")])
    joined = (
        kpis.join(freshness.select("property_id", "latest_final", "fresh_days"), "property_id", "left")
        .join(wide, "property_id", "left")
        .join(brands.select("property_id", F.lit(True).alias("has_brand")), "property_id", "left")
    )
    if appearances is None:
        joined = joined.withColumn("has_appearance", F.lit(None).cast("boolean"))
    else:
        joined = joined.join(
            appearances.select("property_id").distinct().withColumn("has_appearance", F.lit(True)), "property_id", "left")

    def covered(d: str) -> str:
        c = f"{d}_coverage"
        return (f"CASE WHEN {c} >= 80 THEN 'pass' WHEN {c} >= 50 THEN 'warn' "
                f"WHEN {c} IS NOT NULL THEN 'fail' END")

    new = [f"k_{k}.verdict = 'new'" for k in ("clicks", "impressions", "ctr", "average_position")]
    partial = [f"(k_{k}.availability <> 'available' AND k_{k}.verdict <> 'new')"
               for k in ("clicks", "impressions", "ctr", "average_position")]
    return run_checks(joined, [
        period_check(windows),
        check("finalised data only",
              f"CASE WHEN latest_final IS NULL THEN 'warn' ELSE "
              f"'{'pass' if data_state == 'final' else 'warn'}' END", "latest_final"),
        check("fresh data excluded", "CASE WHEN fresh_days > 0 THEN 'pass' END", "fresh_days"),
        check("query coverage of property clicks", covered("query"), grouped("query_coverage", 0)),
        check("page coverage of property clicks", covered("page"), grouped("page_coverage", 0)),
        check("sample size",
              f"if(coalesce(k_clicks.current, 0) < {SEARCH_SMALL_CLICKS}, 'warn', 'pass')",
              grouped("k_clicks.current", 0)),
        check("zero baseline", f"CASE WHEN {' OR '.join(new)} THEN 'warn' END"),
        check("partial metrics", f"CASE WHEN {' OR '.join(partial)} THEN 'warn' END"),
        check("branded split", "CASE WHEN has_brand IS NULL THEN 'skipped' END"),
        check("search appearance", "CASE WHEN has_appearance IS NULL THEN 'skipped' END"),
    ])


def extract_checks(meta: DataFrame) -> DataFrame:
    """Retrieved, complete or truncated, per dataset of the current period.

    `meta` has property_id, dataset, rows_returned (null when the dataset is missing), truncated.
    """
    return meta.selectExpr(
        "property_id", "dataset",
        "CASE WHEN rows_returned IS NULL THEN 'fail' WHEN truncated THEN 'warn' ELSE 'pass' END AS status",
        "CASE WHEN rows_returned IS NULL THEN 'missing' WHEN truncated THEN 'row cap reached' "
        "ELSE 'complete' END AS detail")


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """Warnings once each per property, in the order of their first appearance."""
    return warnings.groupBy("property_id", "text").agg(F.min("seq").alias("seq"))


def first_reasons(unavailable: DataFrame) -> DataFrame:
    """Unavailable names once per property; the first reason stands."""
    return unavailable.groupBy("property_id", "name").agg(
        F.min(F.struct("seq", "reason")).alias("first")).select("property_id", "name", "first.*")


def headline_kpis(kpis_long: DataFrame, preferred: list[str], limit: int = 6) -> DataFrame:
    """Headline figures in a fixed order; once three are shown, unavailable ones are skipped."""
    order = F.array_position(F.array(*[F.lit(k) for k in preferred]), F.col("key"))
    ranked = kpis_long.filter(F.col("key").isin(preferred)).withColumn("order", order)
    w = Window.partitionBy("property_id").orderBy("order")
    missing = F.col("availability") == "unavailable"
    # The k-th row is shown when it is available or when fewer than three rows are shown so far:
    # all of the first three count, after that only available ones do.
    placed = ranked.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= 3) | ~missing)
    return placed.withColumn("position", F.row_number().over(w)).filter(
        F.col("position") <= limit).drop("n", "order")
