"""Paid-ads performance: totals, ratios, KPIs, campaigns, segments and conversion actions.

Facts are rows with property_id, date, the dimensions in use and the base metrics; a metric that
the source did not report is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import (
    ADS_FLOORS, ADS_KPIS, ADS_MATERIAL_PCT, ADS_SPARSE_CLICKS, CAMPAIGN_KPIS,
)
from ..functions.compare import Change, kpi_changes, standard_changes
from ..functions.nulls import half_even, label_or, pct, rnd, rnd_sql, safe_div
from .aggregate import attach, present_in, share_of, top_per, two_period

BASE_METRICS = [
    "impressions", "clicks", "cost", "conversions", "conversions_value", "all_conversions",
    "all_conversions_value",
]
SHARES = {
    "search_impression_share": "impression_share",
    "search_lost_is_budget": "lost_budget",
    "search_lost_is_rank": "lost_rank",
}


def base_measures() -> dict[str, Column]:
    return {m: F.col(m) for m in BASE_METRICS}


def with_share_sums(facts: DataFrame) -> DataFrame:
    """Numerator and weight of every impression-weighted share as columns that add up.

    Rows that already carry them (a roll-up) pass unchanged.
    """
    if "impression_share_num" in facts.columns:
        return facts
    out: dict[str, Column] = {}
    for column in SHARES.values():
        usable = f"{column} IS NOT NULL AND impressions <> 0"
        out[f"{column}_num"] = F.expr(f"CASE WHEN {usable} THEN {column} * impressions END")
        out[f"{column}_den"] = F.expr(f"CASE WHEN {usable} THEN impressions END")
    out["share_seen"] = F.expr("CASE WHEN impression_share IS NOT NULL THEN 1L END")
    return facts.withColumns(out)


SHARE_SUMS = [f"{c}_{part}" for c in SHARES.values() for part in ("num", "den")] + ["share_seen"]


def rollup(facts: DataFrame, dims: list[str]) -> DataFrame:
    """Marked facts summed to `dims`, both flags kept, ready for every operator below."""
    sums = [*BASE_METRICS, *SHARE_SUMS]
    return with_share_sums(facts).groupBy(
        "property_id", *dims, "in_current", "in_previous"
    ).agg(*[F.sum(m).alias(m) for m in sums])


def share_measures() -> dict[str, Column]:
    return {c: F.col(c) for c in SHARE_SUMS}


def with_ratios(totals: DataFrame, prefixes: tuple[str, ...] = ("cur_", "prev_")) -> DataFrame:
    """Rates are derived from the sums, never summed themselves."""
    out: dict[str, Column] = {}
    for p in prefixes:
        c = {m: F.col(p + m) for m in BASE_METRICS}
        out[p + "ctr"] = pct(safe_div(c["clicks"], c["impressions"]))
        out[p + "average_cpc"] = safe_div(c["cost"], c["clicks"])
        out[p + "conversion_rate"] = pct(safe_div(c["conversions"], c["clicks"]))
        out[p + "cost_per_conversion"] = safe_div(c["cost"], c["conversions"])
        out[p + "roas"] = safe_div(c["conversions_value"], c["cost"])
        out[p + "value_per_conversion"] = safe_div(c["conversions_value"], c["conversions"])
    return totals.withColumns(out)


def with_shares(totals: DataFrame, prefixes: tuple[str, ...] = ("cur_", "prev_")) -> DataFrame:
    out = {}
    for p in prefixes:
        for name, column in SHARES.items():
            out[p + name] = pct(safe_div(F.col(f"{p}{column}_num"), F.col(f"{p}{column}_den")))
    return totals.withColumns(out)


def account_totals(facts: DataFrame) -> DataFrame:
    """One row per property with both periods, ratios and weighted shares, from marked facts."""
    sums = two_period(
        with_share_sums(facts), ["property_id"], {**base_measures(), **share_measures()}
    )
    return with_shares(with_ratios(sums))


def totals_with_fallback(account: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Account sums, or campaign sums where the account-level figures are missing."""
    base = [f"{p}{m}" for p in ("cur_", "prev_") for m in BASE_METRICS]
    a = account.select("property_id", *[F.col(c).alias(f"a_{c}") for c in base],
                       F.lit(True).alias("_has"))
    b = campaigns.groupBy("property_id").agg(*[F.sum(c).alias(f"b_{c}") for c in base])
    joined = a.join(b, "property_id", "full_outer")
    return joined.select(
        "property_id",
        *[F.when(F.col("_has"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in base],
        F.col("_has").isNull().alias("from_campaigns"),
    )


def kpis_wide(totals: DataFrame, material_pct: float = ADS_MATERIAL_PCT) -> DataFrame:
    """One struct per KPI per property."""
    changed = kpi_changes(totals, ADS_KPIS, ADS_FLOORS, material_pct)
    return changed.select("property_id", *[f"k_{k.key}" for k in ADS_KPIS])


def cross_checks(kpis: DataFrame, reported_ctr: DataFrame | None = None) -> DataFrame:
    """Notes that turn an arithmetic verdict into an honest one."""
    k = lambda key: F.col(f"k_{key}")
    bought_less = (
        (k("cost")["direction"] == "down") & (k("conversions")["direction"] == "down")
        & (k("cost")["availability"] == "available")
    )
    scale = (
        (k("cost")["direction"] == "up") & (k("conversions")["verdict"] == "improved")
        & k("cost_per_conversion")["verdict"].isin("improved", "flat")
    )
    out = kpis.select(
        "property_id",
        F.when(bought_less, "spend and conversions both fell: no efficiency gain")
        .when(scale, "spend rose while CPA held or improved: scale, not waste")
        .alias("cost_note"),
        k("ctr")["current"].alias("derived_ctr"),
    )
    if reported_ctr is None:
        return out
    drift = F.abs(pct(F.col("reported_ctr")) - F.col("derived_ctr"))
    return out.join(reported_ctr, "property_id", "left").withColumn(
        "ctr_drift", F.coalesce(drift > 0.05, F.lit(False))
    )


def share_coverage(campaign_totals: DataFrame) -> DataFrame:
    """How much of the account the current impression share rests on."""
    reports = F.col("cur_share_seen") > 0
    sums = campaign_totals.filter(F.col("cur_rows") > 0).groupBy("property_id").agg(
        F.coalesce(F.sum("cur_impression_share_den"), F.lit(0)).alias("impressions_covered"),
        F.sum("cur_impressions").alias("impressions_total"),
        F.count_if(reports).alias("campaigns_reporting"),
        F.count("*").alias("campaigns_total"),
    )
    return sums.withColumn(
        "share_of_impressions",
        half_even(share_of(F.col("impressions_covered"), F.col("impressions_total")), 1),
    )


def campaign_totals(facts: DataFrame) -> DataFrame:
    sums = two_period(
        with_share_sums(facts), ["property_id", "campaign_id"],
        {**base_measures(), **share_measures()},
    )
    return with_shares(with_ratios(sums)).withColumn("present_in", present_in())


def account_figures(kpis: DataFrame) -> DataFrame:
    """The account values that campaign rules compare against."""
    return kpis.select(
        "property_id",
        F.col("k_cost.current").alias("account_cost"),
        F.col("k_cost.absolute_change").alias("account_cost_delta"),
        F.col("k_cost_per_conversion.current").alias("account_cpa"),
        F.col("k_roas.current").alias("account_roas"),
    )


def campaign_table(totals: DataFrame, kpis: DataFrame, attributes: DataFrame) -> DataFrame:
    """Campaigns with their change records, share of spend and the nine flags.

    `attributes` has property_id, campaign_id, name, status, channel_type, bidding_strategy and
    daily_budget; both sides are partitioned by the same key.
    """
    named = totals.join(attributes, ["property_id", "campaign_id"], "left")
    joined = attach(named, account_figures(kpis), ["property_id"], ["campaign_id"])
    changed = kpi_changes(joined, CAMPAIGN_KPIS, ADS_FLOORS, ADS_MATERIAL_PCT).withColumns({
        "share_of_spend": F.expr(rnd_sql("100.0D * try_divide(CAST(cur_cost AS DOUBLE), account_cost)", 1)),
        "_spent": F.expr("coalesce(cur_cost <> 0, false)"),
    })
    judged = ("_spent AND cur_conversions <> 0 AND account_cpa <> 0 "
              "AND cur_cost_per_conversion <> 0")
    flags = {
        "sparse_data": f"cur_clicks < {ADS_SPARSE_CLICKS}",
        "spend_no_conversions": "_spent AND cur_conversions = 0",
        "cpa_well_above_account": f"{judged} AND cur_cost_per_conversion > account_cpa * 1.5D",
        "cpa_well_below_account": f"{judged} AND cur_cost_per_conversion < account_cpa * 0.6D",
        "budget_constrained": "cur_search_lost_is_budget >= 10",
        "rank_constrained": "cur_search_lost_is_rank >= 30",
        "paused_but_spent": "status = 'PAUSED' AND _spent",
        "drove_account_spend_change": "account_cost_delta <> 0 "
        "AND abs(k_cost.absolute_change) >= abs(account_cost_delta) * 0.4D",
        "roas_well_above_account": "account_roas <> 0 AND cur_roas > account_roas * 1.3D",
    }
    raised = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in flags.items())
    return changed.withColumn("flags", F.expr(f"array_compact(array({raised}))")).drop("_spent")


def segment_mix(facts: DataFrame, dimension: str) -> DataFrame:
    """Spend mix over a short label list (device, network): shares and their shift in points.

    Shares are rounded before they are subtracted. A property has a handful of labels, so the
    window over it is bounded.
    """
    labelled = facts.withColumn("label", label_or(F.col(dimension), "UNSPECIFIED"))
    sums = with_ratios(two_period(labelled, ["property_id", "label"], base_measures()))
    w = Window.partitionBy("property_id")
    out = {}
    for p in ("cur_", "prev_"):
        own = F.coalesce(F.col(p + "cost"), F.lit(0))
        whole = F.sum(own).over(w)
        out[p + "share"] = F.when(
            (F.col(p + "rows") > 0) & (whole != 0), half_even(share_of(own, whole), 1)
        )
    return sums.withColumns(out).withColumn(
        "shift_pp", half_even(F.col("cur_share") - F.col("prev_share"), 1)
    )


def conversion_actions(facts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Conversion actions of either period or of the set-up, with the change per action.

    `metadata` has property_id, name, category, status, counting_type, primary_for_goal,
    in_conversions_metric.
    """
    named = facts.withColumn("name", label_or(F.col("conversion_action"), "(unnamed)"))
    # The category stays a grouping column in the first step: a string maximum over the facts would
    # turn the hash aggregation into a sort.
    sums = ["cur_all_conversions", "prev_all_conversions", "cur_all_conversions_value",
            "prev_all_conversions_value"]
    measures = {m: F.col(m) for m in ("all_conversions", "all_conversions_value")}
    per_category = two_period(
        named, ["property_id", "name", "conversion_category"], measures, rows=False
    )
    perf = per_category.groupBy("property_id", "name").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("conversion_category").alias("fact_category")
    )
    joined = perf.join(metadata, ["property_id", "name"], "full_outer")
    filled = joined.withColumn(
        "category", F.coalesce("fact_category", "category")
    ).drop("fact_category")
    change = Change("change", "cur_all_conversions", "prev_all_conversions", "decimal", "higher")
    return standard_changes(filled, [change], ADS_FLOORS)


def top_list(facts: DataFrame, keys: list[str], limit: int, shown: int = 25) -> DataFrame:
    """The biggest spenders of the current period, cut at `limit` as the source cuts them.

    `returned` and `capped` say whether the list is complete.
    """
    current = facts.filter("in_current")
    sums = current.groupBy("property_id", *keys).agg(
        *[F.sum(m).alias(m)
          for m in ("cost", "clicks", "impressions", "conversions", "conversions_value")]
    )
    order = [F.col("cost").desc_nulls_last(), *[F.col(k).asc() for k in keys]]
    top = top_per(sums, ["property_id"], order, limit)
    returned = F.count("*").over(Window.partitionBy("property_id"))
    return (
        top.withColumn("returned", returned)
        .withColumn("capped", F.col("returned") >= limit)
        .filter(F.col("rank") <= shown)
        .withColumn("cost_per_conversion", safe_div(F.col("cost"), F.col("conversions")))
    )


def campaigns_by_cost(campaigns: DataFrame, k: int) -> DataFrame:
    order = [F.coalesce(F.col("cur_cost"), F.lit(0)).desc(), F.col("campaign_id").asc()]
    return top_per(campaigns, ["property_id"], order, k)


def daily(facts: DataFrame) -> DataFrame:
    """Base sums per property, period and day; one row per day and period."""
    tagged = facts.withColumn(
        "period",
        F.explode(F.array_compact(F.array(F.when(F.col("in_current"), F.lit("current")),
                                          F.when(F.col("in_previous"), F.lit("previous"))))),
    )
    return tagged.groupBy("property_id", "period", "date").agg(
        *[F.sum(m).alias(m) for m in BASE_METRICS[:5]]
    )


def efficiency_frame(campaigns: DataFrame, top_n: int = 8) -> DataFrame:
    """Campaigns with a CPA in both periods; ROAS where fewer than two of them have one."""
    per = F.count_if(F.col("cur_cost_per_conversion").isNotNull()
                     & F.col("prev_cost_per_conversion").isNotNull())
    with_cpa = campaigns.groupBy("property_id").agg(per.alias("_cpa_rows"))
    chosen = attach(campaigns, with_cpa, ["property_id"], ["campaign_id"])
    use_cpa = F.col("_cpa_rows") >= 2
    points = chosen.select(
        "property_id", "campaign_id", "cur_cost",
        F.when(use_cpa, "cost_per_conversion").otherwise("roas").alias("metric"),
        F.when(use_cpa, F.col("prev_cost_per_conversion")).otherwise(F.col("prev_roas")).alias("previous"),
        F.when(use_cpa, F.col("cur_cost_per_conversion")).otherwise(F.col("cur_roas")).alias("current"),
    ).filter("previous is not null and current is not null")
    return campaigns_by_cost(points, top_n)


def share_stack(campaigns: DataFrame, top_n: int = 8) -> DataFrame:
    """Won, lost to budget, lost to rank and the residual, for campaigns that report a share."""
    won = F.col("cur_search_impression_share")
    budget = F.coalesce("cur_search_lost_is_budget", F.lit(0.0))
    rank = F.coalesce("cur_search_lost_is_rank", F.lit(0.0))
    rows = campaigns.filter(won.isNotNull()).select(
        "property_id", "campaign_id", "cur_cost", won.alias("won"), budget.alias("budget"),
        rank.alias("lost_rank"),
        F.greatest(F.lit(0.0), F.lit(100.0) - (won + budget + rank)).alias("other"),
    )
    return campaigns_by_cost(rows, top_n)


def placeholder_value(totals: DataFrame) -> DataFrame:
    """Properties whose value per conversion looks like a default of 0 or 1."""
    v = F.col("cur_value_per_conversion")
    return totals.filter(
        v.isNotNull() & (F.col("cur_conversions") >= 10)
        & (F.abs(v - half_even(v)) < 0.01) & half_even(v).isin(0.0, 1.0)
    ).select("property_id", rnd(v, 4).alias("value_per_conversion"))


def silent_actions(actions: DataFrame, shown: int = 8) -> DataFrame:
    """Enabled actions that recorded nothing in either period: count and first names."""
    dead = actions.filter(
        (F.col("status") == "ENABLED")
        & (F.coalesce("cur_all_conversions", F.lit(0)) == 0)
        & (F.coalesce("prev_all_conversions", F.lit(0)) == 0)
    ).select("property_id", "name")
    counts = dead.groupBy("property_id").agg(F.count("*").alias("silent"))
    first = top_per(dead, ["property_id"], [F.col("name").asc()], shown)
    names = first.groupBy("property_id").agg(
        F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names")
    )
    return counts.join(names, "property_id")
