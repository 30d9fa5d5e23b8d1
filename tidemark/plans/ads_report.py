"""The paid-ads report for every account: one scan of the facts, then roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.catalog import ADS_KPIS, HEADLINES
from ..functions.compare import long_kpis
from ..operators import ads, ads_findings, quality
from ..operators.findings import ordered, union_findings, with_sentences
from ..operators.periods import Windows, mark
from ..session import stage

ROLLUP_DIMS = ["campaign_id", "device", "network", "conversion_action", "conversion_category",
               "date"]


def build(
    facts: DataFrame,
    attributes: DataFrame,
    action_metadata: DataFrame,
    windows: Windows,
    currency: str = "''",
    top_lists: dict[str, tuple[list[str], int]] | None = None,
) -> dict[str, DataFrame]:
    """All parts of the report by name. `currency` is SQL text over the KPI row."""
    rows = mark(facts, windows)
    base = stage(ads.rollup(rows, ROLLUP_DIMS), "ads-rollup")
    # A few rows per property, read by most parts below: worth a table of its own size.
    totals = stage(ads.account_totals(base), "ads-totals")
    kpis = stage(ads.kpis_wide(totals), "ads-kpis")
    campaigns = stage(
        ads.campaign_table(ads.campaign_totals(base), kpis, attributes), "ads-campaigns")
    device, network = ads.segment_mix(base, "device"), ads.segment_mix(base, "network")
    actions = ads.conversion_actions(base, action_metadata)
    daily = ads.daily(base)
    findings = stage(union_findings([
        ads_findings.account_findings(kpis, currency),
        ads_findings.campaign_findings(campaigns, currency),
        ads_findings.mix_findings(device, "Device"),
        ads_findings.mix_findings(network, "Network"),
        ads_findings.tracking_findings(kpis, ads.silent_actions(actions)),
    ]), "ads-findings")
    long = long_kpis(kpis, ADS_KPIS, ["property_id"])
    report = {
        "kpis": long,
        "headlines": quality.headline_kpis(long.drop("position"), HEADLINES["ads"]),
        "cross_checks": ads.cross_checks(kpis),
        "campaigns": campaigns,
        "device_mix": device,
        "network_mix": network,
        "conversion_actions": actions,
        "daily": daily,
        "findings": with_sentences(findings),
        "recommendations": ordered(ads_findings.recommendations(findings)),
        "checks": quality.ads_checks(
            kpis, totals, campaigns, daily, ads.share_coverage(campaigns), windows),
        "unavailable": quality.unavailable_metrics(kpis, ADS_KPIS),
        "efficiency": ads.efficiency_frame(campaigns),
        "share_stack": ads.share_stack(campaigns),
    }
    for name, (keys, limit) in (top_lists or {}).items():
        report[name] = ads.top_list(rows, keys, limit)
    return report
