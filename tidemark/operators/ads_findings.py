"""Rules over paid-ads figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ADS_KPIS, ADS_SMALL_CONVERSIONS
from ..functions.display import evidence_line, grouped, money
from .findings import Rule, fire, recommend, rule, with_lines


def account_findings(kpis: DataFrame, currency: str = "''") -> DataFrame:
    low = f"coalesce(k_conversions.current, 0.0) < {ADS_SMALL_CONVERSIONS}"
    by_sample = f"if({low}, 'low', 'high')"
    gap = "(k_cost.percent_change - k_conversions.percent_change)"
    outpaced = f"coalesce(k_cost.percent_change > 5 AND {gap} > 15, false)"

    def material(key):
        return f"k_{key}.material AND k_{key}.availability = 'available'"

    def gain(key):
        return f"if(k_{key}.verdict = 'improved', 'strength', 'weakness')"

    def lines(*keys):
        return [f"e_{key}" for key in keys]

    cpa_worse = "k_cost_per_conversion.verdict = 'declined'"
    rules = [
        rule(outpaced, "'spend_outpacing_conversions'", "'weakness'",
             f"if({low}, 'medium', 'high')", f"if({low}, 'medium', 'high')",
             evidence=lines("cost", "conversions", "cost_per_conversion")),
        rule(f"NOT {outpaced} AND k_conversions.percent_change > 5 AND {gap} < -15",
             "'conversions_outpacing_spend'", "'strength'", "'medium'",
             f"if({low}, 'medium', 'high')",
             evidence=lines("conversions", "cost", "cost_per_conversion")),
        rule(material("cost_per_conversion"), "'cpa_shift'",
             f"if({cpa_worse}, 'weakness', 'strength')",
             f"if({cpa_worse} AND NOT {low}, 'high', 'medium')", by_sample,
             amount="abs(k_cost_per_conversion.absolute_change) * coalesce(k_conversions.current, 0)",
             evidence=lines("cost_per_conversion", "conversions", "cost")),
        rule(material("roas"), "'roas_shift'", gain("roas"), f"if({low}, 'medium', 'high')",
             by_sample, evidence=lines("roas", "conversions_value", "cost")),
    ]
    for key in ("conversions", "conversions_value", "clicks"):
        rules.append(rule(
            material(key), f"'{key}_shift'", gain(key),
            "'high'" if key == "conversions" else "'medium'",
            "'high'" if key == "clicks" else by_sample,
            evidence=lines(key, "cost",
                           "average_cpc" if key == "clicks" else "cost_per_conversion"),
        ))
    for key in ("ctr", "average_cpc", "conversion_rate"):
        rules.append(rule(
            material(key), f"'{key}_shift'", gain(key), "'medium'",
            by_sample if key == "conversion_rate" else "'high'", evidence=lines(key),
        ))
    rules += [
        rule("k_average_cpc.direction = 'down' AND k_conversion_rate.direction = 'down' "
             "AND k_average_cpc.material AND k_conversion_rate.material",
             "'cheap_traffic_low_quality'", "'anomaly'", "'medium'", "'medium'",
             evidence=lines("average_cpc", "conversion_rate", "clicks")),
        rule(material("search_impression_share"), "'impression_share_shift'",
             gain("search_impression_share"),
             evidence=lines("search_impression_share", "search_lost_is_budget",
                            "search_lost_is_rank")),
        rule("k_search_lost_is_budget.current >= 10", "'budget_capped_account'", "'opportunity'",
             "if(k_search_lost_is_budget.current >= 20, 'high', 'medium')",
             amount="k_search_lost_is_budget.current",
             evidence=lines("search_lost_is_budget", "cost_per_conversion", "cost")),
        rule("k_search_lost_is_rank.current >= 30", "'rank_limited_account'", "'weakness'",
             evidence=lines("search_lost_is_rank", "search_lost_is_budget", "ctr")),
    ]
    return fire(with_lines(kpis, ADS_KPIS, currency), rules)


def campaign_findings(campaigns: DataFrame, currency: str = "''") -> DataFrame:
    def has(flag):
        return f"array_contains(flags, '{flag}')"

    sparse = has("sparse_data")
    spend = f"concat('Spend: ', {money('cur_cost', currency)})"
    cpa = (f"concat('CPA: ', {money('cur_cost_per_conversion', currency)}, ' vs account ', "
           f"{money('account_cpa', currency)})")
    clicks = f"concat('Clicks: ', {grouped('coalesce(cur_clicks, 0)', 0)})"
    efficient = ("coalesce(account_cpa <> 0 AND cur_cost_per_conversion <> 0 "
                 "AND cur_cost_per_conversion <= account_cpa, false)")
    common = {"scope": "'campaign'", "entity": "name"}

    def ident(prefix):
        return f"concat('{prefix}:', campaign_id)"

    rules = [
        rule(f"{has('spend_no_conversions')} AND share_of_spend >= 5",
             ident("campaign_no_conversions"), "'weakness'", f"if({sparse}, 'low', 'high')",
             f"if({sparse}, 'low', 'high')", amount="cur_cost",
             evidence=[spend, clicks, "'Conversions: 0'"], **common),
        rule(f"{has('cpa_well_above_account')} AND NOT {sparse}",
             ident("campaign_high_cpa"), "'weakness'",
             "if(coalesce(share_of_spend, 0) >= 15, 'high', 'medium')",
             amount="greatest(0.0D, coalesce(CAST(cur_cost AS DOUBLE), 0.0D) "
                    "- coalesce(account_cpa, 0.0D) * coalesce(CAST(cur_conversions AS DOUBLE), 0.0D))",
             detail="channel_type", evidence=[cpa, spend], **common),
        rule(f"{has('cpa_well_below_account')} AND NOT {sparse}",
             ident("campaign_low_cpa"), "'strength'", evidence=[cpa, spend], **common),
        rule(has("budget_constrained"), ident("campaign_budget_constrained"),
             f"if({efficient}, 'opportunity', 'observation')", f"if({efficient}, 'high', 'low')",
             f"if({sparse}, 'medium', 'high')", amount="cur_search_lost_is_budget",
             evidence=[f"concat('Daily budget: ', {money('daily_budget', currency)})", cpa],
             **common),
        rule(has("rank_constrained"), ident("campaign_rank_constrained"), "'weakness'",
             amount="cur_search_lost_is_rank",
             evidence=[f"concat('Search lost IS (rank): ', "
                       f"{grouped('cur_search_lost_is_rank', 1)}, '%')"], **common),
        rule(has("paused_but_spent"), ident("campaign_paused_but_spent"), "'observation'", "'low'",
             evidence=["'Status now: PAUSED'", spend], **common),
        rule(has("drove_account_spend_change"), ident("campaign_spend_swing"), "'observation'",
             "'low'", evidence=[evidence_line("k_cost", "'Spend'", "currency", currency)],
             **common),
        rule("present_in = 'current only' AND coalesce(cur_cost <> 0, false)",
             ident("campaign_new"), "'observation'", "'low'", evidence=[spend], **common),
        rule("present_in = 'previous only'", ident("campaign_stopped"), "'observation'", "'low'",
             evidence=[f"concat('Previous spend: ', {money('prev_cost', currency)})"], **common),
    ]
    # Almost no traffic cannot carry a confident finding, whichever rule fired.
    found = fire(campaigns, rules, ("property_id", f"{sparse} AS sparse"))
    return found.withColumns({
        "confidence": F.expr("if(sparse AND severity <> 'low', 'low', confidence)"),
        "severity": F.expr("if(sparse, 'low', severity)"),
    }).drop("sparse")


def mix_findings(segments: DataFrame, dimension_label: str) -> DataFrame:
    return fire(segments, [
        rule("abs(shift_pp) >= 10", f"concat('mix_shift:{dimension_label}:', label)", "'anomaly'",
             scope="'segment'", entity="label", amount="shift_pp",
             evidence=[f"concat(label, ' spend share: ', {grouped('cur_share', 1)}, '% vs ', "
                       f"{grouped('prev_share', 1)}, '%')"]),
    ])


def tracking_findings(kpis: DataFrame, silent: DataFrame) -> DataFrame:
    """`silent` is the output of `silent_actions`."""
    conv, value = "k_conversions.current", "k_conversions_value.current"
    vpc = f"try_divide({value}, {conv})"
    rate = "k_conversion_rate.current"
    scope = {"scope": "'tracking'"}
    return fire(kpis.join(silent, "property_id", "left"), [
        rule(f"{conv} = 0 AND coalesce(k_cost.current, 0) > 0", "'no_conversions_recorded'",
             "'anomaly'", "'high'", amount="k_cost.current",
             evidence=[f"concat('Spend: ', {grouped('k_cost.current', 2)})", "'Conversions: 0'"],
             **scope),
        rule(f"{conv} > 0 AND coalesce({value}, 0) = 0", "'no_conversion_value'",
             "'observation'", "'low'",
             evidence=[f"concat('Conversions: ', {grouped(conv, 1)})",
                       f"if({value} = 0, 'Conversion value: 0', 'Conversion value: not returned')"],
             **scope),
        rule(f"{conv} >= 10 AND abs({vpc} - rint({vpc})) < 0.01 AND rint({vpc}) IN (0, 1)",
             "'placeholder_conversion_value'", "'anomaly'", "'medium'", "'medium'", amount=vpc,
             evidence=[f"concat('Value per conversion: ', {grouped(vpc, 2)})"], **scope),
        rule(f"{rate} > 50", "'very_high_conversion_rate'", "'observation'", "'low'", "'medium'",
             amount=rate, evidence=[f"concat('Conversion rate: ', {grouped(rate, 1)}, '%')"],
             **scope),
        rule("silent > 0", "'inactive_conversion_actions'", "'observation'", "'low'", "'medium'",
             amount="silent", evidence=["concat('Silent actions: ', names)"], **scope),
    ])


ADS_RULES: list[Rule] = [
    ("campaign_no_conversions", None, None, "low", "Low", "medium",
     "Give {entity} a test window and a decision date"),
    ("campaign_no_conversions", None, None, "high", "High", "high",
     "Pause or restructure {entity} and check its conversion tracking"),
    ("campaign_budget_constrained", None, "high", None, "High", "high",
     "Raise the daily budget on {entity}"),
    ("campaign_high_cpa", None, None, None, None, "high", "Audit {entity}"),
    ("campaign_rank_constrained", None, None, None, "Medium", "high", "Work ad rank on {entity}"),
    ("spend_outpacing_conversions", None, None, None, "High", "high",
     "Re-check bidding targets and budget pacing"),
    ("cpa_shift", "weakness", None, None, "High", None,
     "Find the campaigns behind the CPA increase"),
    ("budget_capped_account", None, None, None, None, "high",
     "Decide whether to fund the impressions lost to budget"),
    ("no_conversions_recorded", None, None, None, "High", "high",
     "Verify conversion tracking end to end"),
    ("placeholder_conversion_value", None, None, None, "Medium", "medium",
     "Replace the flat conversion value with real values"),
    ("inactive_conversion_actions", None, None, None, "Low", "medium",
     "Fix or archive the silent conversion actions"),
]


def recommendations(findings: DataFrame) -> DataFrame:
    """Recommendations; for an expensive campaign the audit follows its channel."""
    return recommend(findings, ADS_RULES).withColumn("action", F.expr(
        "CASE WHEN NOT startswith(from_finding, 'campaign_high_cpa:') THEN action "
        "WHEN upper(detail) IN ('SEARCH', 'SHOPPING') THEN action || ' by search term and ad group' "
        "WHEN upper(detail) = 'PERFORMANCE_MAX' THEN action || ' by asset group and listing group' "
        "WHEN upper(detail) IN ('DISPLAY', 'VIDEO', 'DEMAND_GEN') "
        "THEN action || ' by placement and audience' "
        "ELSE action || ' by its own targeting dimensions' END"
    ))
