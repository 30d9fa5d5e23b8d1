"""The web-analytics report for every property, from events."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.catalog import ECOMMERCE_KPIS, HEADLINES, WEB_KPIS, WEB_MIN_SESSIONS
from ..functions.compare import long_kpis
from ..operators import quality, timeseries, web, web_findings, web_history
from ..operators.findings import ordered, union_findings, with_sentences
from ..operators.periods import Windows, calendar, flag
from ..session import stage

DIMENSIONS = {"channels": "channel", "devices": "device", "landing_pages": "landing_page",
              "geo_country": "country"}


def build(
    events: DataFrame,
    definitions: DataFrame,
    windows: Windows,
    dimensions: dict[str, str] | None = None,
    min_sessions: int = WEB_MIN_SESSIONS,
    gap_minutes: int = 30,
    warnings: DataFrame | None = None,
    history: str | None = None,
) -> dict[str, DataFrame]:
    """All parts of the report by name. `definitions` are the key events of each property.

    `dimensions` names a breakdown for each column of the sessions; columns of the events are carried
    over to the sessions as needed. `warnings` (property_id, seq, text) are data-quality notes of the
    source; each distinct one becomes a finding. `history` is the folder of kept first days
    (`web_history.keep`); with it the events of the windows are read instead of all there are.
    """
    own = set(DIMENSIONS.values()) | {"first_channel"}
    carried = tuple(sorted({c for c in (dimensions or {}).values() if c in events.columns} - own))
    if history is None:
        sessions = flag(web.with_first_seen(web.sessionize(events, gap_minutes, carried)), windows)
    else:
        sessions = web_history.windowed_sessions(events, windows, history, gap_minutes, carried)
    sessions = stage(sessions, "web-sessions")
    marked = flag(events, windows).filter("in_current OR in_previous")
    totals = stage(web.totals(sessions), "web-totals")
    kpis = stage(web.kpis_wide(totals), "web-kpis")
    segments = stage(web.all_breakdowns(sessions, dimensions or DIMENSIONS), "web-segments")

    def of(dataset):
        return segments.filter(segments["dataset"] == dataset)

    def with_property(df):
        return web.with_property_sessions(df, kpis)

    events_table = stage(web.event_table(marked, definitions), "web-events")
    daily = stage(web.daily(sessions), "web-daily")
    current = daily.filter("period = 'current'")
    days = calendar(windows, totals.select("property_id"))
    missing = timeseries.missing_days(days, current)
    anomalies = timeseries.web_anomalies(current, ["sessions", "keyEvents", "totalRevenue"])
    drift = timeseries.drift(current)
    pages = of("landing_pages")
    judged = web.judged_landing_pages(pages, min_sessions)
    page_movers = web.movers(pages.filter(
        f"coalesce(cur_sessions, 0) >= {min_sessions} OR coalesce(prev_sessions, 0) >= {min_sessions}"), 6)
    funnel = web.funnel(kpis)
    notes = [] if warnings is None else [web_findings.quality_findings(quality.distinct_warnings(warnings))]
    found = union_findings([
        *notes,
        web_findings.kpi_findings(kpis, min_sessions),
        web_findings.segment_findings(
            with_property(web.movers(of("channels"), 5)), "acquisition", min_sessions),
        web_findings.landing_findings(judged, with_property(page_movers), pages, min_sessions),
        web_findings.device_findings(web.device_gap(of("devices"), min_sessions)),
        web_findings.event_findings(events_table, kpis.select("property_id", "baseline_empty")),
        web_findings.silent_key_events(events_table, definitions),
        web_findings.trend_findings(missing, anomalies, drift),
        web_findings.ecommerce_findings(funnel, kpis),
        web_findings.geo_findings(
            with_property(web.geo_movers(of("geo_country"), min_sessions))),
    ])
    findings = stage(web_findings.with_gap_caveat(found, missing), "web-findings")
    long = long_kpis(kpis, WEB_KPIS + ECOMMERCE_KPIS, ["property_id"])
    return {
        "kpis": long,
        "headlines": quality.headline_kpis(long.drop("position"), HEADLINES["web"]),
        "segments": web.ranked(segments), "events": events_table, "funnel": funnel,
        "daily": timeseries.on_calendar(days, daily), "missing_days": missing,
        "anomalies": anomalies, "drift": drift, "findings": with_sentences(findings),
        "recommendations": ordered(web_findings.recommendations(findings)),
        "checks": quality.web_checks(kpis, missing, windows, min_sessions),
        "unattributed": web.unattributed(
            segments, ["channels", "landing_pages", "source_medium"]),
        "direct_surge": web.direct_surge(of("channels")),
        "unavailable": quality.unavailable_metrics(kpis, WEB_KPIS),
    }
