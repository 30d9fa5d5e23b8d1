"""Rules over web-analytics figures. `detail = 'down'` marks a decline that a gap may explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import (
    AUTOMATIC_EVENTS, ECOMMERCE_KPIS, WEB_KPIS, WEB_MIN_KEY_EVENTS, WEB_MIN_SESSIONS,
)
from ..functions.display import WEB_STYLE, delta_text, evidence_line, grouped, percent_text
from .aggregate import attach, ranked_all
from .findings import Rule, fire, recommend, rule, with_lines


def kpi_findings(
    kpis: DataFrame, min_sessions: int = WEB_MIN_SESSIONS, currency: str = "''"
) -> DataFrame:
    def has(key):
        return f"k_{key}.availability = 'available'"

    def lines(*keys):
        return [f"e_{k}" for k in keys]

    scope = {"scope": "'property'"}
    both = f"NOT baseline_empty AND {has('sessions')} AND {has('keyEvents')}"
    gap = "(k_eventCount.percent_change - k_sessions.percent_change)"
    new_share = "(k_newUsers.{0} / nullif(k_totalUsers.{0}, 0) * 100.0D)"
    shift = f"({new_share.format('current')} - {new_share.format('previous')})"
    shop = (f"NOT baseline_empty AND ecommerce_state = 'active' AND {has('totalRevenue')} "
            f"AND {has('sessions')}")
    lost_revenue = ("k_totalRevenue.verdict = 'declined' "
                    "AND k_sessions.verdict IN ('flat', 'improved')")
    rules = [
        rule("baseline_empty", "'no_baseline'", "'observation'",
             evidence=lines("sessions", "activeUsers", "keyEvents"), **scope),
        rule(f"{both} AND k_sessions.direction = 'up' AND k_keyEvents.verdict = 'declined' "
             "AND (k_sessions.material OR k_keyEvents.material)",
             "'traffic_up_key_events_down'", "'weakness'", "'high'",
             evidence=lines("sessions", "keyEvents", "sessionKeyEventRate"), **scope),
        rule(f"{both} AND k_sessions.direction = 'down' AND k_keyEvents.verdict = 'improved'",
             "'traffic_down_key_events_up'", "'strength'", "'medium'",
             evidence=lines("sessions", "keyEvents", "sessionKeyEventRate"), **scope),
        rule(f"{both} AND k_sessions.verdict = 'improved' AND k_keyEvents.verdict = 'improved'",
             "'traffic_and_key_events_up'", "'strength'", "'low'",
             evidence=lines("sessions", "keyEvents", "sessionKeyEventRate"), **scope),
        rule(f"{both} AND k_sessions.verdict = 'declined' AND k_keyEvents.verdict = 'declined'",
             "'traffic_and_key_events_down'", "'weakness'", "'high'", detail="'down'",
             evidence=lines("sessions", "keyEvents"), **scope),
        rule(f"NOT baseline_empty AND {has('engagementRate')} AND k_engagementRate.material "
             "AND k_engagementRate.verdict IN ('improved', 'declined')",
             "'engagement_rate_move'",
             "if(k_engagementRate.verdict = 'improved', 'strength', 'weakness')",
             "if(abs(k_engagementRate.absolute_change) < 5, 'medium', 'high')",
             detail="k_engagementRate.direction",
             evidence=lines("engagementRate", "averageSessionDuration",
                            "screenPageViewsPerSession"), **scope),
        rule(f"NOT baseline_empty AND {has('sessionKeyEventRate')} "
             "AND k_sessionKeyEventRate.material AND k_sessionKeyEventRate.verdict = 'declined'",
             "'key_event_rate_decline'", "'weakness'", "'high'",
             amount="abs(k_sessionKeyEventRate.absolute_change / 100.0D * k_sessions.current)",
             evidence=lines("sessionKeyEventRate", "keyEvents", "sessions"), **scope),
        rule(f"NOT baseline_empty AND abs({gap}) >= 40 "
             "AND abs(k_eventCount.percent_change) >= 25",
             "'event_volume_vs_traffic'", "'anomaly'", "'medium'", "'medium'", "'tracking'",
             amount=gap, evidence=lines("eventCount", "sessions", "eventsPerSession")),
        rule(f"NOT baseline_empty AND abs({shift}) >= 8", "'new_user_mix_shift'",
             "'observation'", "'low'", amount=shift,
             evidence=lines("newUsers", "totalUsers"), **scope),
        rule(f"{shop} AND {lost_revenue}", "'revenue_down_traffic_stable'", "'weakness'",
             "'high'", scope="'ecommerce'",
             evidence=lines("totalRevenue", "sessions", "averagePurchaseRevenue",
                            "transactions")),
        rule(f"{shop} AND NOT ({lost_revenue}) AND k_totalRevenue.verdict = 'improved' "
             "AND k_totalRevenue.material", "'revenue_up'", "'strength'", "'medium'",
             scope="'ecommerce'",
             evidence=lines("totalRevenue", "transactions", "averagePurchaseRevenue")),
    ]
    # Arithmetic does not know when a number is too small to mean anything.
    thin = (f"(NOT baseline_empty AND (({has('sessions')} "
            f"AND k_sessions.current < {min_sessions * 10}) OR ({has('keyEvents')} "
            f"AND least(k_keyEvents.current, k_keyEvents.previous) < {WEB_MIN_KEY_EVENTS})))")
    lined = with_lines(kpis, WEB_KPIS + ECOMMERCE_KPIS, currency, WEB_STYLE)
    found = fire(lined, rules, ("property_id", f"{thin} AS thin"))
    return found.withColumns({
        "severity": F.expr("if(thin, 'low', severity)"),
        "confidence": F.expr("if(thin, 'low', confidence)"),
    }).drop("thin")


def _moved(label: str) -> str:
    return (f"concat({label}, ' sessions: ', coalesce({grouped('cur_sessions', 0)}, "
            f"'not available'), ' vs ', coalesce({grouped('prev_sessions', 0)}, 'not available'), "
            f"' (', {delta_text('d_sessions.absolute_change', 'int')}, ', ', "
            f"{percent_text('d_sessions.percent_change', 'd_sessions.verdict', WEB_STYLE)}, ')')")


_GAINING = "d_sessions.direction = 'up'"


def segment_findings(
    movers: DataFrame, scope: str = "acquisition", min_sessions: int = WEB_MIN_SESSIONS
) -> DataFrame:
    """`movers` carry total_sessions and baseline_empty."""
    small = (f"(coalesce(cur_sessions, 0) < {min_sessions} "
             f"AND coalesce(prev_sessions, 0) < {min_sessions})")
    share = ("coalesce(CAST(cur_sessions AS DOUBLE) / nullif(total_sessions, 0) * 100.0D, 0.0D)")
    return fire(movers, [
        rule("NOT baseline_empty", f"concat('{scope}_move:', key)",
             f"if({_GAINING}, 'strength', 'weakness')",
             f"CASE WHEN {small} THEN 'low' WHEN {share} > 15 THEN 'high' ELSE 'medium' END",
             f"if({small}, 'low', 'high')", f"'{scope}'", "key",
             amount="d_sessions.absolute_change", detail=f"if({_GAINING}, 'up', 'down')",
             evidence=[_moved("key"), f"concat({grouped(share, 1)}, '% of sessions this period')"]),
    ])


def landing_findings(
    judged: DataFrame, movers: DataFrame, pages: DataFrame, min_sessions: int = WEB_MIN_SESSIONS
) -> DataFrame:
    """Weak pages among the first fifteen judged, big movers, or a note that none is judged."""
    big = f"judged_rank <= 15 AND cur_sessions >= {min_sessions * 2}"
    weak = fire(judged, [
        rule(f"{big} AND cur_engagementRate < median_engagement - 15",
             "concat('landing_weak_engagement:', key)", "'weakness'", "'medium'",
             scope="'content'", entity="key", amount="cur_engagementRate",
             evidence=[f"concat(key, ': ', {grouped('cur_engagementRate', 1)}, '% against ', "
                       f"{grouped('median_engagement', 1)}, '% median')"]),
        rule(f"{big} AND cur_keyEvents = 0", "concat('landing_no_key_events:', key)",
             "'weakness'", "'medium'", "'medium'", "'content'", "key", amount="cur_sessions",
             evidence=[f"concat(key, ': ', {grouped('cur_sessions', 0)}, ' sessions, 0 key events')"]),
    ])
    moved = fire(movers, [
        rule("NOT baseline_empty", "concat('landing_move:', key)",
             f"if({_GAINING}, 'strength', 'weakness')", "'medium'", scope="'content'",
             entity="key", amount="d_sessions.absolute_change",
             detail=f"if({_GAINING}, 'up', 'down')", evidence=[_moved("key")]),
    ])
    best = pages.groupBy("property_id").agg(
        F.max(F.coalesce("cur_sessions", F.lit(0))).alias("best"))
    none = fire(best.filter(F.col("best") < min_sessions), [
        rule("true", "'landing_pages_below_floor'", "'observation'", "'low'", scope="'content'",
             amount="best",
             evidence=[f"concat('Top landing page: ', {grouped('best', 0)}, ' sessions')"]),
    ])
    # With no page judged there is nothing to move either.
    anything = judged.select("property_id").distinct()
    return weak.unionByName(moved.join(anything, "property_id", "left_semi")).unionByName(none)


def device_findings(gaps: DataFrame) -> DataFrame:
    return fire(gaps, [
        rule("true", "'device_key_event_gap'", "'weakness'",
             "if(relative >= 50, 'high', 'medium')", scope="'device'", amount="relative",
             detail="if(gap > 0, 'mobile', 'desktop')",
             evidence=[f"concat('Desktop: ', {grouped('desktop_rate', 1)}, '% session key event rate')",
                       f"concat('Mobile: ', {grouped('mobile_rate', 1)}, '% session key event rate')"]),
    ])


def event_findings(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """Events that stopped, appeared or swung. `baselines` has property_id and baseline_empty."""
    stopped = "(prev_eventCount >= 25 AND coalesce(cur_eventCount, 0) = 0)"
    fresh = "(coalesce(prev_eventCount, 0) = 0 AND cur_eventCount >= 50)"
    swing = ("(abs(d_count.percent_change) >= 60 AND prev_eventCount >= 100 "
             "AND d_count.availability = 'available')")
    line = evidence_line("d_count", "event_name", "int", style=WEB_STYLE)
    common = {"entity": "event_name", "evidence": [line]}
    automatic = ", ".join(f"'{e}'" for e in AUTOMATIC_EVENTS)
    return fire(attach(events, baselines, ["property_id"], ["event_name"], "inner"), [
        rule(f"NOT baseline_empty AND {stopped}", "concat('event_stopped:', event_name)",
             "'anomaly'", "if(is_key_event, 'high', 'medium')", "'medium'", "'tracking'", **common),
        rule(f"NOT baseline_empty AND NOT {stopped} AND {fresh}",
             "concat('event_new:', event_name)", "'observation'", "'low'", "'medium'",
             "'tracking'", **common),
        rule(f"NOT baseline_empty AND NOT {stopped} AND NOT {fresh} AND {swing}",
             "concat('event_swing:', event_name)",
             "if(abs(d_count.percent_change) >= 150, 'anomaly', 'observation')",
             "if(is_key_event, 'high', 'low')", "'medium'",
             "if(is_key_event, 'events', 'tracking')",
             detail=f"CASE WHEN is_key_event THEN 'key event' WHEN event_name IN ({automatic}) "
                    "THEN 'automatic' ELSE 'check the tag' END", **common),
    ])


def silent_key_events(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """Properties that define key events of which none was recorded."""
    defined = definitions.groupBy("property_id").agg(F.count("*").alias("defined"))
    fired = events.filter("is_key_event").select("property_id").distinct()
    return fire(defined.join(fired, "property_id", "left_anti"), [
        rule("true", "'key_events_defined_but_silent'", "'risk'", "'high'", scope="'tracking'",
             amount="defined",
             evidence=["concat('Defined key events: ', CAST(defined AS STRING))"]),
    ])


def trend_findings(missing: DataFrame, anomalies: DataFrame, drift: DataFrame) -> DataFrame:
    """Days without data, abnormal days (first six) and drift inside the period."""
    gaps = missing.groupBy("property_id").agg(
        F.count("*").alias("days"), F.min("date").alias("first_day"))
    order = ("CASE metric WHEN 'sessions' THEN 1 WHEN 'keyEvents' THEN 2 ELSE 3 END")
    w = Window.partitionBy("property_id").orderBy(F.expr(order), "date")
    first = anomalies.withColumn("n", F.row_number().over(w)).filter("n <= 6")
    parts = [
        fire(gaps, [rule(
            "days > 0", "'daily_missing_days'", "'anomaly'", "if(days > 1, 'high', 'medium')",
            "'medium'", "'tracking'", amount="days",
            evidence=["concat(CAST(days AS STRING), ' day(s) without data from ', first_day)"])]),
        fire(first, [rule(
            "true", "concat('daily_', direction, '_', date)", "'anomaly'", "'low'", "'medium'",
            "'property'", amount="z", detail="metric",
            evidence=[f"concat(metric, ' on ', date, ': ', {grouped('value', 0)}, "
                      f"' (period median ', {grouped('median', 0)}, ')')"])]),
        fire(drift, [rule(
            "abs(drift) >= 0.25", "'trend_within_period'", "'observation'", "'medium'",
            scope="'property'", amount="drift",
            evidence=[f"concat('Second half against first half: ', "
                      f"{percent_text('drift * 100')})"])]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ecommerce_findings(funnel: DataFrame, kpis: DataFrame) -> DataFrame:
    drop = "(step_rate_previous - step_rate_current)"
    steps = fire(funnel, [
        rule(f"{drop} >= 5 AND step_rate_previous > 0", "concat('ecom_step_drop:', key)",
             "'weakness'", f"if({drop} >= 10, 'high', 'medium')", scope="'ecommerce'",
             amount=drop,
             evidence=[f"concat(label, ': step rate ', {grouped('step_rate_current', 1)}, '% vs ', "
                       f"{grouped('step_rate_previous', 1)}, '%')"]),
    ])
    aov, tx = "k_averagePurchaseRevenue", "k_transactions"
    volume = fire(kpis, [
        rule(f"ecommerce_state = 'active' AND {aov}.availability = 'available' "
             f"AND {tx}.availability = 'available' AND {aov}.material AND {tx}.material "
             f"AND {aov}.direction <> {tx}.direction", "'ecom_aov_vs_volume'", "'observation'",
             "'medium'", scope="'ecommerce'",
             evidence=[evidence_line(aov, "'Avg. Purchase Revenue'", "currency", style=WEB_STYLE),
                       evidence_line(tx, "'Transactions'", "int", style=WEB_STYLE)]),
    ])
    return steps.unionByName(volume)


def geo_findings(movers: DataFrame) -> DataFrame:
    return fire(movers, [
        rule("NOT baseline_empty", "concat('geo_move:', key)", "'observation'", "'low'",
             scope="'geo'", entity="key", amount="d_sessions.absolute_change",
             evidence=[_moved("key")]),
    ])


def with_gap_caveat(findings: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing days make every decline partly an artefact: its confidence drops."""
    gaps = missing.select("property_id").distinct().withColumn("gap", F.lit(True))
    marked = findings.join(gaps, "property_id", "left")
    hit = "gap AND type IN ('weakness', 'risk') AND detail = 'down'"
    return marked.withColumn(
        "confidence", F.expr(f"if(coalesce({hit}, false), 'low', confidence)")).drop("gap")


def quality_findings(warnings: DataFrame) -> DataFrame:
    """One risk per data-quality warning; `warnings` has property_id, seq and text, and any number of
    warnings for a property."""
    return fire(ranked_all(warnings, ["property_id"], ["seq"], "n"), [
        rule("true", "concat('data_quality:', lpad(CAST(n AS STRING), 2, '0'))", "'risk'",
             "'medium'", scope="'tracking'", evidence=["text"]),
    ])


WEB_RULES: list[Rule] = [
    ("traffic_up_key_events_down", None, None, None, "High", "high",
     "Verify the key-event tags, then split the key event rate by channel and landing page"),
    ("key_event_rate_decline", None, None, None, "High", "high",
     "Compare the key event rate by landing page and device in both periods"),
    ("event_stopped", None, None, None, "High", "medium",
     "Check tag, trigger and consent conditions for {entity}"),
    ("device_key_event_gap", None, None, None, None, "high",
     "Compare the key-event funnel of the weaker device with the stronger one"),
    ("landing_weak_engagement", None, None, None, None, "high",
     "Review {entity} against better-engaging entry pages"),
    ("landing_no_key_events", None, None, None, None, "medium",
     "Confirm that a key event can be reached from {entity}"),
    ("landing_move", "weakness", None, None, None, "high",
     "Trace the entrance loss on {entity} to a channel"),
    ("acquisition_move", "weakness", None, None, None, "high", "Diagnose the {entity} decline"),
    ("acquisition_move", "strength", None, None, "Medium", "high",
     "Confirm that the {entity} gain lasts"),
    ("ecom_step_drop", None, None, None, None, "high", "Review the step that lost progression"),
    ("revenue_down_traffic_stable", None, None, None, "High", "high",
     "Split revenue by channel and device in both periods"),
    ("key_events_defined_but_silent", None, None, None, "High", "high",
     "Treat conversion reporting as unavailable until key events are confirmed"),
    ("event_volume_vs_traffic", None, None, None, "Medium", "medium",
     "Compare the tag configuration of the two periods"),
    ("daily_missing_days", None, None, None, "High", "medium",
     "Establish what happened on the days without data"),
]


def recommendations(findings: DataFrame) -> DataFrame:
    """One action once, at its highest priority."""
    return recommend(findings, WEB_RULES, dedupe=True)
