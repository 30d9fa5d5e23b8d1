"""Registered queries over paid-ads facts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.catalog import ADS_FLOORS, ADS_KPIS, CAMPAIGN_KPIS
from tidemark.functions.compare import long_kpis
from tidemark.operators import ads, ads_findings
from tidemark.operators.findings import ordered, union_findings
from tidemark.operators.periods import mark
from tidemark.plans.ads_report import ROLLUP_DIMS
from tidemark.session import stage

from . import sqlgen as g
from .views import (
    ACTION_META_SQL, AD_SQL, YEAR_WINDOWS, action_metadata, ad_stats, campaign_dim,
)

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def marked(spark, sf):
    return mark(ad_stats(spark, sf), YEAR_WINDOWS)


def kpi_row(spark, sf):
    return ads.kpis_wide(ads.account_totals(marked(spark, sf)))


def campaigns(spark, sf):
    """Account and campaign figures from one roll-up of the facts."""
    base = stage(ads.rollup(marked(spark, sf), ["campaign_id"]), "campaigns")
    kpis = ads.kpis_wide(ads.account_totals(base))
    return ads.campaign_table(ads.campaign_totals(base), kpis, campaign_dim(spark, sf))


def actions(spark, sf):
    return ads.conversion_actions(marked(spark, sf), action_metadata(spark, sf))


BASE = {m: m for m in ads.BASE_METRICS}
SHARE = {}
for _c in ("impression_share", "lost_budget", "lost_rank"):
    _ok = f"{_c} IS NOT NULL AND impressions <> 0"
    SHARE[f"{_c}_num"] = f"CASE WHEN {_ok} THEN {_c} * impressions END"
    SHARE[f"{_c}_den"] = f"CASE WHEN {_ok} THEN impressions END"


def ratios_sql(source: str, name: str) -> str:
    cols = []
    for p in ("cur_", "prev_"):
        cols += [
            f"{g.div(p + 'clicks', p + 'impressions')} * 100.0 AS {p}ctr",
            f"{g.div(p + 'cost', p + 'clicks')} AS {p}average_cpc",
            f"{g.div(p + 'conversions', p + 'clicks')} * 100.0 AS {p}conversion_rate",
            f"{g.div(p + 'cost', p + 'conversions')} AS {p}cost_per_conversion",
            f"{g.div(p + 'conversions_value', p + 'cost')} AS {p}roas",
            f"{g.div(p + 'conversions_value', p + 'conversions')} AS {p}value_per_conversion",
        ]
    return f"{name} AS (SELECT *, " + ", ".join(cols) + f" FROM {source})"


def shares_sql(source: str, name: str) -> str:
    cols = []
    for p in ("cur_", "prev_"):
        for out, c in ads.SHARES.items():
            cols.append(f"{g.div(f'{p}{c}_num', f'{p}{c}_den')} * 100.0 AS {p}{out}")
    return f"{name} AS (SELECT *, " + ", ".join(cols) + f" FROM {source})"


TOTALS = [
    AD_SQL,
    f"t0 AS (SELECT property_id, {g.two({**BASE, **SHARE})} FROM adw GROUP BY property_id)",
    ratios_sql("t0", "t1"), shares_sql("t1", "tot"),
]
SPECS = [(k.key, k.label, k.unit, k.better, ADS_FLOORS[k.unit]) for k in ADS_KPIS]
KPIS = TOTALS + [g.unpivot("tot", "property_id", SPECS), g.std_chg("kl")]
KPI_WIDE = KPIS + [g.pivot("chg", "property_id", [k.key for k in ADS_KPIS])]

KPI_COLUMNS = ["property_id", "position", "key", "label", "unit", "better_when", "current", "previous",
               "absolute_change", "percent_change", "availability", "direction", "verdict", "material"]
KPI_SELECT = """SELECT property_id, position, key, label, unit, better AS better_when, c AS current, p AS previous,
  absolute_change, percent_change, availability, direction, verdict, material FROM chg"""


@register("c1_ads_kpis", g.with_(*KPIS) + KPI_SELECT)
def c1_ads_kpis(spark, sf):
    return long_kpis(kpi_row(spark, sf), ADS_KPIS, ["property_id"]).select(*KPI_COLUMNS)


@register("a02_ads_totals", g.with_(*TOTALS) + """
SELECT property_id, cur_impressions, prev_impressions, cur_clicks, prev_clicks, cur_cost, prev_cost,
  cur_conversions, prev_conversions, cur_conversions_value, prev_conversions_value, cur_all_conversions,
  prev_all_conversions, cur_rows, prev_rows FROM tot""")
def a02_ads_totals(spark, sf):
    cols = [f"{p}{m}" for m in ads.BASE_METRICS[:6] for p in ("cur_", "prev_")]
    t = ads.account_totals(marked(spark, sf))
    return t.select("property_id", *[F.col(c).cast("double").alias(c) for c in cols], "cur_rows", "prev_rows")


@register("p07_ads_ratios", g.with_(*TOTALS) + """
SELECT property_id, cur_ctr, prev_ctr, cur_average_cpc, prev_average_cpc, cur_conversion_rate, prev_conversion_rate,
  cur_cost_per_conversion, prev_cost_per_conversion, cur_roas, prev_roas, cur_value_per_conversion,
  prev_value_per_conversion FROM tot""")
def p07_ads_ratios(spark, sf):
    names = ("ctr", "average_cpc", "conversion_rate", "cost_per_conversion", "roas", "value_per_conversion")
    return ads.account_totals(marked(spark, sf)).select(
        "property_id", *[f"{p}{n}" for n in names for p in ("cur_", "prev_")])


REPORTED = """rep AS (SELECT property_id, sum(clicks)::DOUBLE / sum(impressions)::DOUBLE
    * CASE WHEN min(campaign_id) % 2 = 0 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS reported_ctr
  FROM adw WHERE in_current GROUP BY property_id)"""


@register("c3_c4_ads_cross_checks", g.with_(*KPI_WIDE, REPORTED) + """
SELECT property_id, CASE WHEN cost_dir = 'down' AND conversions_dir = 'down' AND cost_avail = 'available'
    THEN 'spend and conversions both fell: no efficiency gain'
  WHEN cost_dir = 'up' AND conversions_verdict = 'improved' AND cost_per_conversion_verdict IN ('improved', 'flat')
    THEN 'spend rose while CPA held or improved: scale, not waste' END AS cost_note,
  ctr_cur AS derived_ctr, reported_ctr,
  coalesce(abs(reported_ctr * 100.0 - ctr_cur) > 0.05, false) AS ctr_drift
FROM kw LEFT JOIN rep USING (property_id)""")
def c3_c4_ads_cross_checks(spark, sf):
    current = marked(spark, sf).filter("in_current")
    reported = current.groupBy("property_id").agg(
        (F.sum("clicks").cast("double") / F.sum("impressions").cast("double")
         * F.when(F.min("campaign_id") % 2 == 0, 1.3).otherwise(1.0)).alias("reported_ctr"))
    return ads.cross_checks(kpi_row(spark, sf), reported)


CAMP = [
    AD_SQL,
    f"c0 AS (SELECT property_id, campaign_id, {g.two({**BASE, **SHARE})} FROM adw GROUP BY property_id, campaign_id)",
    ratios_sql("c0", "c1"), shares_sql("c1", "c2"),
    """camp AS (SELECT *, CASE WHEN cur_rows > 0 AND prev_rows > 0 THEN 'both' WHEN cur_rows > 0 THEN 'current only'
      ELSE 'previous only' END AS present_in FROM c2)""",
]


@register("a03_a25_share_coverage", g.with_(*CAMP) + f"""
SELECT property_id, coalesce(sum(cur_impression_share_den), 0)::DOUBLE AS impressions_covered,
  sum(cur_impressions)::DOUBLE AS impressions_total, count(cur_impression_share_den) AS campaigns_reporting,
  count(*) AS campaigns_total,
  {g.rnd('100.0::DOUBLE * ' + g.div('coalesce(sum(cur_impression_share_den), 0)', 'sum(cur_impressions)'), 1)} AS share_of_impressions
FROM camp WHERE cur_rows > 0 GROUP BY property_id""")
def a03_a25_share_coverage(spark, sf):
    c = ads.share_coverage(ads.campaign_totals(marked(spark, sf)))
    return c.withColumns({n: F.col(n).cast("double") for n in ("impressions_covered", "impressions_total")})


@register("a07_campaign_totals", g.with_(*CAMP) + """
SELECT property_id, campaign_id, present_in, cur_impressions, prev_impressions, cur_clicks, prev_clicks, cur_cost,
  prev_cost, cur_conversions, prev_conversions, cur_roas, prev_roas, cur_search_impression_share,
  prev_search_impression_share, cur_search_lost_is_budget, cur_search_lost_is_rank FROM camp""")
def a07_campaign_totals(spark, sf):
    t = ads.campaign_totals(marked(spark, sf))
    cols = [f"{p}{m}" for m in ads.BASE_METRICS[:4] for p in ("cur_", "prev_")]
    return t.select("property_id", "campaign_id", "present_in",
                    *[F.col(c).cast("double").alias(c) for c in cols], "cur_roas", "prev_roas",
                    "cur_search_impression_share", "prev_search_impression_share",
                    "cur_search_lost_is_budget", "cur_search_lost_is_rank")


CAMP_CHG = CAMP + [
    g.unpivot("camp", "property_id, campaign_id",
              [(k.key, k.label, k.unit, k.better, ADS_FLOORS[k.unit]) for k in CAMPAIGN_KPIS]),
    g.std_chg("kl"),
]


@register("c7_campaign_changes", g.with_(*CAMP_CHG) + """
SELECT property_id, campaign_id, key, c AS current, p AS previous, absolute_change, percent_change, direction, verdict,
  material FROM chg""")
def c7_campaign_changes(spark, sf):
    return long_kpis(campaigns(spark, sf), CAMPAIGN_KPIS, ["property_id", "campaign_id"]).select(
        "property_id", "campaign_id", "key", "current", "previous", "absolute_change", "percent_change",
        "direction", "verdict", "material")


FLAGGED = CAMP + [
    f"t0 AS (SELECT property_id, {g.two({**BASE, **SHARE})} FROM adw GROUP BY property_id)",
    ratios_sql("t0", "t1"),
    """acct AS (SELECT property_id, cur_cost AS account_cost, cur_cost - prev_cost AS account_cost_delta,
      cur_cost_per_conversion AS account_cpa, cur_roas AS account_roas FROM t1)""",
    f"""fl AS (SELECT c.*, a.account_cost, a.account_cost_delta, a.account_cpa, a.account_roas, d.name, d.status,
      d.channel_type, d.daily_budget, c.cur_cost - c.prev_cost AS cost_delta,
      CASE WHEN account_cost <> 0 THEN {g.rnd('100.0::DOUBLE * ' + g.div('c.cur_cost', 'account_cost'), 1)} END AS share_of_spend,
      coalesce(cur_clicks < 100, false) AS f1,
      coalesce(cur_cost <> 0 AND cur_conversions = 0, false) AS f2,
      coalesce(cur_cost <> 0 AND cur_conversions <> 0 AND account_cpa <> 0 AND cur_cost_per_conversion > account_cpa * 1.5, false) AS f3,
      coalesce(cur_cost <> 0 AND cur_conversions <> 0 AND account_cpa <> 0 AND cur_cost_per_conversion <> 0
        AND cur_cost_per_conversion < account_cpa * 0.6, false) AS f4,
      coalesce(cur_search_lost_is_budget >= 10, false) AS f5,
      coalesce(cur_search_lost_is_rank >= 30, false) AS f6,
      coalesce(d.status = 'PAUSED' AND cur_cost <> 0, false) AS f7,
      coalesce(account_cost_delta <> 0 AND abs(c.cur_cost - c.prev_cost) >= abs(account_cost_delta) * 0.4, false) AS f8,
      coalesce(account_roas <> 0 AND cur_roas > account_roas * 1.3, false) AS f9
    FROM camp c LEFT JOIN acct a USING (property_id) LEFT JOIN campaign_dim d USING (property_id, campaign_id))""",
]
FLAG_TEXT = """concat_ws(',', CASE WHEN f1 THEN 'sparse_data' END, CASE WHEN f2 THEN 'spend_no_conversions' END,
  CASE WHEN f3 THEN 'cpa_well_above_account' END, CASE WHEN f4 THEN 'cpa_well_below_account' END,
  CASE WHEN f5 THEN 'budget_constrained' END, CASE WHEN f6 THEN 'rank_constrained' END,
  CASE WHEN f7 THEN 'paused_but_spent' END, CASE WHEN f8 THEN 'drove_account_spend_change' END,
  CASE WHEN f9 THEN 'roas_well_above_account' END)"""


@register("an20_campaign_flags", g.with_(*FLAGGED) + f"""
SELECT property_id, campaign_id, name, status, channel_type, present_in, share_of_spend, {FLAG_TEXT} AS flags FROM fl""")
def an20_campaign_flags(spark, sf):
    return campaigns(spark, sf).select(
        "property_id", "campaign_id", "name", "status", "channel_type", "present_in", "share_of_spend",
        F.concat_ws(",", "flags").alias("flags"))


@register("s1_campaigns_by_cost", g.with_(*CAMP) + """
SELECT property_id, campaign_id, cur_cost, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY coalesce(cur_cost, 0) DESC, campaign_id) AS rank FROM camp) WHERE rank <= 15""")
def s1_campaigns_by_cost(spark, sf):
    top = ads.campaigns_by_cost(ads.campaign_totals(marked(spark, sf)), 15)
    return top.select("property_id", "campaign_id", F.col("cur_cost").cast("double").alias("cur_cost"), "rank")


def _mix_sql(dimension: str) -> list[str]:
    return [
        AD_SQL,
        f"""m0 AS (SELECT property_id, CASE WHEN {dimension} IS NULL OR {dimension} = '' THEN 'UNSPECIFIED' ELSE {dimension} END AS label,
      {g.two(BASE)} FROM adw GROUP BY 1, 2)""",
        """m1 AS (SELECT *, sum(coalesce(cur_cost, 0)) OVER (PARTITION BY property_id) AS cw,
      sum(coalesce(prev_cost, 0)) OVER (PARTITION BY property_id) AS pw FROM m0)""",
        f"""m2 AS (SELECT *, CASE WHEN cur_rows > 0 THEN {g.rnd('100.0::DOUBLE * ' + g.div('coalesce(cur_cost, 0)', 'cw'), 1)} END AS cur_share,
      CASE WHEN prev_rows > 0 THEN {g.rnd('100.0::DOUBLE * ' + g.div('coalesce(prev_cost, 0)', 'pw'), 1)} END AS prev_share FROM m1)""",
        f"mix AS (SELECT *, {g.rnd('cur_share - prev_share', 1)} AS shift_pp FROM m2)",
    ]


MIX_SELECT = "SELECT property_id, label, cur_cost, prev_cost, cur_share, prev_share, shift_pp FROM mix"


def _mix(spark, sf, dimension):
    return ads.segment_mix(marked(spark, sf), dimension)


def _mix_out(df):
    return df.select("property_id", "label", F.col("cur_cost").cast("double").alias("cur_cost"),
                     F.col("prev_cost").cast("double").alias("prev_cost"), "cur_share", "prev_share", "shift_pp")


@register("a08_an21_device_mix", g.with_(*_mix_sql("device")) + MIX_SELECT)
def a08_an21_device_mix(spark, sf):
    return _mix_out(_mix(spark, sf, "device"))


@register("a08_an21_network_mix", g.with_(*_mix_sql("network")) + MIX_SELECT)
def a08_an21_network_mix(spark, sf):
    return _mix_out(_mix(spark, sf, "network"))


def _top_sql(keys: str, limit: int) -> str:
    return g.with_(AD_SQL, f"""k0 AS (SELECT property_id, {keys}, CAST(sum(cost) AS DOUBLE) AS cost, sum(clicks)::DOUBLE AS clicks,
    sum(impressions)::DOUBLE AS impressions, sum(conversions)::DOUBLE AS conversions FROM adw WHERE in_current GROUP BY ALL)""",
        f"k1 AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY cost DESC NULLS LAST, {keys}) AS rank FROM k0)",
        f"k2 AS (SELECT *, count(*) OVER (PARTITION BY property_id) AS returned FROM k1 WHERE rank <= {limit})") + f"""
SELECT property_id, {keys}, cost, clicks, impressions, conversions, {g.div('cost', 'conversions')} AS cost_per_conversion,
  rank, returned, returned >= {limit} AS capped FROM k2 WHERE rank <= 25"""


def _top(spark, sf, keys, limit):
    t = ads.top_list(marked(spark, sf), keys, limit)
    return t.select("property_id", *keys,
                    *[F.col(c).cast("double").alias(c) for c in ("cost", "clicks", "impressions", "conversions")],
                    "cost_per_conversion", "rank", "returned", "capped")


@register("a09_s2_top_keywords", _top_sql("campaign_id, ad_group, keyword", 100))
def a09_s2_top_keywords(spark, sf):
    return _top(spark, sf, ["campaign_id", "ad_group", "keyword"], 100)


@register("a09_s2_top_ad_groups", _top_sql("campaign_id, ad_group", 100))
def a09_s2_top_ad_groups(spark, sf):
    return _top(spark, sf, ["campaign_id", "ad_group"], 100)


@register("a09_f9_top_search_terms", _top_sql("keyword", 200))
def a09_f9_top_search_terms(spark, sf):
    return _top(spark, sf, ["keyword"], 200)


ACT = [
    AD_SQL, ACTION_META_SQL,
    """a0 AS (SELECT property_id, coalesce(conversion_action, '(unnamed)') AS name, max(conversion_category) AS fact_category,
      CAST(sum(CASE WHEN in_current THEN all_conversions END) AS DOUBLE) AS cur_all, CAST(sum(CASE WHEN in_previous THEN all_conversions END) AS DOUBLE) AS prev_all,
      CAST(sum(CASE WHEN in_current THEN all_conversions_value END) AS DOUBLE) AS cur_value FROM adw GROUP BY 1, 2)""",
    """a1 AS (SELECT property_id, name, coalesce(fact_category, m.category) AS category, m.status, m.counting_type,
      cur_all AS c, prev_all AS p, cur_value, 0.1::DOUBLE AS floor, 'higher' AS better
      FROM a0 FULL JOIN action_meta m USING (property_id, name))""",
    g.std_chg("a1"),
]


@register("a10_j3_conversion_actions", g.with_(*ACT) + """
SELECT property_id, name, category, status, counting_type, c AS current, p AS previous, cur_value, percent_change,
  availability, direction, verdict, material FROM chg""")
def a10_j3_conversion_actions(spark, sf):
    return actions(spark, sf).select(
        "property_id", "name", "category", "status", "counting_type", F.col("change.current").alias("current"),
        F.col("change.previous").alias("previous"),
        F.col("cur_all_conversions_value").cast("double").alias("cur_value"),
        *[F.col(f"change.{c}").alias(c) for c in ("percent_change", "availability", "direction", "verdict", "material")])


SILENT = ACT + [
    """dead AS (SELECT property_id, name FROM chg WHERE status = 'ENABLED' AND coalesce(c, 0) = 0 AND coalesce(p, 0) = 0)""",
    """silent AS (SELECT property_id, count(*) AS silent, string_agg(name, ', ' ORDER BY name) FILTER (rn <= 8) AS names
      FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY name) AS rn FROM dead) GROUP BY property_id)""",
]


@register("an29_silent_actions", g.with_(*SILENT) + "SELECT property_id, silent, names FROM silent")
def an29_silent_actions(spark, sf):
    return ads.silent_actions(actions(spark, sf))


@register("an28_placeholder_value", g.with_(*TOTALS) + f"""
SELECT property_id, {g.rnd('cur_value_per_conversion', 4)} AS value_per_conversion FROM tot
WHERE cur_conversions >= 10 AND abs(cur_value_per_conversion - round_even(cur_value_per_conversion, 0)) < 0.01
  AND round_even(cur_value_per_conversion, 0) IN (0, 1)""")
def an28_placeholder_value(spark, sf):
    return ads.placeholder_value(ads.account_totals(marked(spark, sf)))


@register("an30_campaign_efficiency", g.with_(*CAMP,
    """n AS (SELECT property_id, count(*) FILTER (cur_cost_per_conversion IS NOT NULL AND prev_cost_per_conversion IS NOT NULL) AS n FROM camp GROUP BY 1)""",
    """pts AS (SELECT property_id, campaign_id, cur_cost, CASE WHEN n >= 2 THEN 'cost_per_conversion' ELSE 'roas' END AS metric,
      CASE WHEN n >= 2 THEN prev_cost_per_conversion ELSE prev_roas END AS previous,
      CASE WHEN n >= 2 THEN cur_cost_per_conversion ELSE cur_roas END AS current FROM camp JOIN n USING (property_id))""") + """
SELECT property_id, campaign_id, metric, previous, current, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY coalesce(cur_cost, 0) DESC, campaign_id) AS rank FROM pts WHERE previous IS NOT NULL AND current IS NOT NULL) WHERE rank <= 8""")
def an30_campaign_efficiency(spark, sf):
    return ads.efficiency_frame(ads.campaign_totals(marked(spark, sf))).select(
        "property_id", "campaign_id", "metric", "previous", "current", "rank")


@register("an30_share_stack", g.with_(*CAMP) + """
SELECT property_id, campaign_id, won, budget, lost_rank, greatest(0.0::DOUBLE, 100.0::DOUBLE - (won + budget + lost_rank)) AS other, rank
FROM (SELECT property_id, campaign_id, cur_search_impression_share AS won, coalesce(cur_search_lost_is_budget, 0)::DOUBLE AS budget,
    coalesce(cur_search_lost_is_rank, 0)::DOUBLE AS lost_rank,
    row_number() OVER (PARTITION BY property_id ORDER BY coalesce(cur_cost, 0) DESC, campaign_id) AS rank
  FROM camp WHERE cur_search_impression_share IS NOT NULL) WHERE rank <= 8""")
def an30_share_stack(spark, sf):
    return ads.share_stack(ads.campaign_totals(marked(spark, sf))).drop("cur_cost")


DAILY_SQL = """
d AS (SELECT property_id, 'current' AS period, date, impressions, clicks, cost, conversions, conversions_value FROM adw WHERE in_current
  UNION ALL SELECT property_id, 'previous', date, impressions, clicks, cost, conversions, conversions_value FROM adw WHERE in_previous)"""


@register("a06_s7_ads_daily", g.with_(AD_SQL, DAILY_SQL) + """
SELECT property_id, period, CAST(date AS VARCHAR) AS date, sum(impressions)::DOUBLE AS impressions, sum(clicks)::DOUBLE AS clicks,
  CAST(sum(cost) AS DOUBLE) AS cost, sum(conversions)::DOUBLE AS conversions, sum(conversions_value)::DOUBLE AS conversions_value
FROM d GROUP BY 1, 2, 3""")
def a06_s7_ads_daily(spark, sf):
    return ads.daily(marked(spark, sf)).select(
        "property_id", "period", F.col("date").cast("string").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ads.BASE_METRICS[:5]])


@register("j5_totals_fallback", g.with_(*CAMP) + """
SELECT property_id, sum(CAST(cur_cost AS DECIMAL(20,2)))::DOUBLE AS cur_cost, sum(CAST(prev_cost AS DECIMAL(20,2)))::DOUBLE AS prev_cost,
  sum(cur_clicks) AS cur_clicks, property_id LIKE '%3' AS from_campaigns FROM camp GROUP BY property_id""")
def j5_totals_fallback(spark, sf):
    account = ads.account_totals(marked(spark, sf)).filter("property_id NOT LIKE '%3'")
    t = ads.totals_with_fallback(account, ads.campaign_totals(marked(spark, sf)))
    return t.select("property_id", *[F.col(c).cast("double").alias(c) for c in ("cur_cost", "prev_cost", "cur_clicks")],
                    "from_campaigns")


# --- findings -------------------------------------------------------------------------------

FINDING_OUT = ["property_id", "id", "type", "severity", "confidence", "scope", "entity"]
_LOW = "coalesce(conversions_cur, 0) < 30"
_CONF = f"CASE WHEN {_LOW} THEN 'low' ELSE 'high' END"
_OUT = "coalesce(cost_pct > 5 AND cost_pct - conversions_pct > 15, false)"


def _gain(k):
    return f"CASE WHEN {k}_verdict = 'improved' THEN 'strength' ELSE 'weakness' END"


def _mat(k):
    return f"{k}_material AND {k}_avail = 'available'"


def _acct(cond, i, t, s, c="'high'"):
    return (cond, f"'{i}'", t, s, c, "'account'", "NULL")


ACCOUNT_RULES = [
    _acct(_OUT, "spend_outpacing_conversions", "'weakness'", f"CASE WHEN {_LOW} THEN 'medium' ELSE 'high' END",
          f"CASE WHEN {_LOW} THEN 'medium' ELSE 'high' END"),
    _acct(f"NOT {_OUT} AND conversions_pct > 5 AND cost_pct - conversions_pct < -15", "conversions_outpacing_spend",
          "'strength'", "'medium'", f"CASE WHEN {_LOW} THEN 'medium' ELSE 'high' END"),
    _acct(_mat("cost_per_conversion"), "cpa_shift",
          "CASE WHEN cost_per_conversion_verdict = 'declined' THEN 'weakness' ELSE 'strength' END",
          f"CASE WHEN cost_per_conversion_verdict = 'declined' AND NOT {_LOW} THEN 'high' ELSE 'medium' END", _CONF),
    _acct(_mat("roas"), "roas_shift", _gain("roas"), f"CASE WHEN {_LOW} THEN 'medium' ELSE 'high' END", _CONF),
    _acct(_mat("conversions"), "conversions_shift", _gain("conversions"), "'high'", _CONF),
    _acct(_mat("conversions_value"), "conversions_value_shift", _gain("conversions_value"), "'medium'", _CONF),
    _acct(_mat("clicks"), "clicks_shift", _gain("clicks"), "'medium'"),
    _acct(_mat("ctr"), "ctr_shift", _gain("ctr"), "'medium'"),
    _acct(_mat("average_cpc"), "average_cpc_shift", _gain("average_cpc"), "'medium'"),
    _acct(_mat("conversion_rate"), "conversion_rate_shift", _gain("conversion_rate"), "'medium'", _CONF),
    _acct("average_cpc_dir = 'down' AND conversion_rate_dir = 'down' AND average_cpc_material AND conversion_rate_material",
          "cheap_traffic_low_quality", "'anomaly'", "'medium'", "'medium'"),
    _acct(_mat("search_impression_share"), "impression_share_shift", _gain("search_impression_share"), "'medium'"),
    _acct("search_lost_is_budget_cur >= 10", "budget_capped_account", "'opportunity'",
          "CASE WHEN search_lost_is_budget_cur >= 20 THEN 'high' ELSE 'medium' END"),
    _acct("search_lost_is_rank_cur >= 30", "rank_limited_account", "'weakness'", "'medium'"),
]
ACCOUNT_FINDINGS = f"acct_f AS ({g.findings('kw', ACCOUNT_RULES)})"


@register("fa01_fa11_account_findings", g.with_(*KPI_WIDE, ACCOUNT_FINDINGS) + "SELECT * FROM acct_f")
def fa01_fa11_account_findings(spark, sf):
    return ads_findings.account_findings(kpi_row(spark, sf)).select(*FINDING_OUT)


def _c(cond, prefix, t, s, c="'high'"):
    return (cond, f"'{prefix}:' || campaign_id", t, s, c, "'campaign'", "name")


_EFF = "coalesce(account_cpa <> 0 AND cur_cost_per_conversion <> 0 AND cur_cost_per_conversion <= account_cpa, false)"
CAMPAIGN_RULES = [
    _c("f2 AND share_of_spend >= 5", "campaign_no_conversions", "'weakness'", "CASE WHEN f1 THEN 'low' ELSE 'high' END",
       "CASE WHEN f1 THEN 'low' ELSE 'high' END"),
    _c("f3 AND NOT f1", "campaign_high_cpa", "'weakness'", "CASE WHEN coalesce(share_of_spend, 0) >= 15 THEN 'high' ELSE 'medium' END"),
    _c("f4 AND NOT f1", "campaign_low_cpa", "'strength'", "'medium'"),
    _c("f5", "campaign_budget_constrained", f"CASE WHEN {_EFF} THEN 'opportunity' ELSE 'observation' END",
       f"CASE WHEN {_EFF} THEN 'high' ELSE 'low' END", "CASE WHEN f1 THEN 'medium' ELSE 'high' END"),
    _c("f6", "campaign_rank_constrained", "'weakness'", "'medium'"),
    _c("f7", "campaign_paused_but_spent", "'observation'", "'low'"),
    _c("f8", "campaign_spend_swing", "'observation'", "'low'"),
    _c("present_in = 'current only' AND cur_cost <> 0", "campaign_new", "'observation'", "'low'"),
    _c("present_in = 'previous only'", "campaign_stopped", "'observation'", "'low'"),
]
CAMPAIGN_FINDINGS = f"""camp_f AS (SELECT property_id, id, type,
    CASE WHEN f1 AND severity <> 'low' THEN 'low' ELSE severity END AS severity,
    CASE WHEN f1 AND severity <> 'low' THEN 'low' ELSE confidence END AS confidence, scope, entity
  FROM ({g.findings('fl', CAMPAIGN_RULES, 'property_id, f1')}))"""


@register("fa12_fa19_campaign_findings", g.with_(*FLAGGED, CAMPAIGN_FINDINGS) + "SELECT * FROM camp_f")
def fa12_fa19_campaign_findings(spark, sf):
    return ads_findings.campaign_findings(campaigns(spark, sf)).select(*FINDING_OUT)


def _mix_findings_sql(dimension, label):
    return g.with_(*_mix_sql(dimension)) + f"""
SELECT property_id, 'mix_shift:{label}:' || label AS id, 'anomaly' AS type, 'medium' AS severity, 'high' AS confidence,
  'segment' AS scope, label AS entity, shift_pp AS amount FROM mix WHERE abs(shift_pp) >= 10"""


@register("fa20_mix_shift", _mix_findings_sql("device", "Device"))
def fa20_mix_shift(spark, sf):
    return ads_findings.mix_findings(_mix(spark, sf, "device"), "Device").select(*FINDING_OUT, "amount")


_VPC = g.div("conversions_value_cur", "conversions_cur")
TRACK_RULES = [
    ("conversions_cur = 0 AND coalesce(cost_cur, 0) > 0", "'no_conversions_recorded'", "'anomaly'", "'high'", "'high'", "'tracking'", "NULL"),
    ("conversions_cur > 0 AND (conversions_value_cur IS NULL OR conversions_value_cur = 0)", "'no_conversion_value'",
     "'observation'", "'low'", "'high'", "'tracking'", "NULL"),
    (f"conversions_cur >= 10 AND abs({_VPC} - round_even({_VPC}, 0)) < 0.01 AND round_even({_VPC}, 0) IN (0, 1)",
     "'placeholder_conversion_value'", "'anomaly'", "'medium'", "'medium'", "'tracking'", "NULL"),
    ("conversion_rate_cur > 50", "'very_high_conversion_rate'", "'observation'", "'low'", "'medium'", "'tracking'", "NULL"),
    ("silent > 0", "'inactive_conversion_actions'", "'observation'", "'low'", "'medium'", "'tracking'", "NULL"),
]
TRACK = [c.replace("chg AS", "achg AS").replace("FROM chg", "FROM achg") for c in SILENT[1:]]
TRACK_FINDINGS = f"""trk AS (SELECT * FROM kw LEFT JOIN silent USING (property_id)),
track_f AS ({g.findings('trk', TRACK_RULES)})"""


@register("fa21_fa25_tracking_findings", g.with_(*KPI_WIDE, *TRACK, TRACK_FINDINGS) + "SELECT * FROM track_f")
def fa21_fa25_tracking_findings(spark, sf):
    silent = ads.silent_actions(actions(spark, sf))
    return ads_findings.tracking_findings(kpi_row(spark, sf), silent).select(*FINDING_OUT)


def all_findings(spark, sf):
    rows = stage(ads.rollup(marked(spark, sf), ROLLUP_DIMS), "rollup")
    kpis = stage(ads.kpis_wide(ads.account_totals(rows)), "kpis")
    table = ads.campaign_table(ads.campaign_totals(rows), kpis, campaign_dim(spark, sf))
    silent = ads.silent_actions(ads.conversion_actions(rows, action_metadata(spark, sf)))
    return union_findings([
        ads_findings.account_findings(kpis),
        ads_findings.campaign_findings(table),
        ads_findings.mix_findings(ads.segment_mix(rows, "device"), "Device"),
        ads_findings.mix_findings(ads.segment_mix(rows, "network"), "Network"),
        ads_findings.tracking_findings(kpis, silent),
    ])


RECS = """raw AS (
  SELECT property_id, id, CASE WHEN confidence = 'low' THEN 'Low' ELSE 'High' END AS priority,
    CASE WHEN confidence = 'low' THEN 'medium' ELSE 'high' END AS confidence FROM camp_f WHERE id LIKE 'campaign_no_conversions:%'
  UNION ALL SELECT property_id, id, 'High', 'high' FROM camp_f WHERE id LIKE 'campaign_budget_constrained:%' AND severity = 'high'
  UNION ALL SELECT property_id, id, CASE WHEN severity = 'high' THEN 'High' ELSE 'Medium' END, 'high' FROM camp_f WHERE id LIKE 'campaign_high_cpa:%'
  UNION ALL SELECT property_id, id, 'Medium', 'high' FROM camp_f WHERE id LIKE 'campaign_rank_constrained:%'
  UNION ALL SELECT property_id, id, 'High', 'high' FROM acct_f WHERE id = 'spend_outpacing_conversions'
  UNION ALL SELECT property_id, id, 'High', confidence FROM acct_f WHERE id = 'cpa_shift' AND type = 'weakness'
  UNION ALL SELECT property_id, id, CASE WHEN severity = 'high' THEN 'High' ELSE 'Medium' END, 'high' FROM acct_f WHERE id = 'budget_capped_account'
  UNION ALL SELECT property_id, id, 'High', 'high' FROM track_f WHERE id = 'no_conversions_recorded'
  UNION ALL SELECT property_id, id, 'Medium', 'medium' FROM track_f WHERE id = 'placeholder_conversion_value'
  UNION ALL SELECT property_id, id, 'Low', 'medium' FROM track_f WHERE id = 'inactive_conversion_actions'
)"""
_FLAG_ONLY = [c for c in FLAGGED[1:] if not c.startswith(("t0 AS", "t1 AS"))]


@register("r1_s6_ads_recommendations", g.with_(*KPI_WIDE, *TRACK, TRACK_FINDINGS, *_FLAG_ONLY, ACCOUNT_FINDINGS,
                                               CAMPAIGN_FINDINGS, RECS) + """
SELECT property_id, id AS from_finding, priority, confidence, row_number() OVER (PARTITION BY property_id
  ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, id) AS position FROM raw""")
def r1_s6_ads_recommendations(spark, sf):
    recs = ordered(ads_findings.recommendations(all_findings(spark, sf)))
    return recs.select("property_id", "from_finding", "priority", "confidence", "position")


@register("r4_ads_cpa_excess", g.with_(*FLAGGED) + """
SELECT property_id, campaign_id, greatest(0.0::DOUBLE, coalesce(cur_cost, 0) - coalesce(account_cpa, 0) * coalesce(cur_conversions, 0)) AS excess
FROM fl WHERE f3 AND NOT f1""")
def r4_ads_cpa_excess(spark, sf):
    f = ads_findings.campaign_findings(campaigns(spark, sf)).filter(F.col("id").startswith("campaign_high_cpa:"))
    return f.select("property_id", F.substring_index("id", ":", -1).cast("bigint").alias("campaign_id"),
                    F.col("amount").alias("excess"))
