"""The organic-search report for every property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import HEADLINES, SEARCH_KPIS
from ..functions.compare import long_kpis
from ..operators import quality, search, search_findings, timeseries
from ..operators.findings import union_findings, with_sentences
from ..operators.periods import Windows, mark
from ..session import stage

ROLLUP_DIMS = ["search_type", "query", "page", "device", "country", "appearance"]


def dimension(rows: DataFrame, figures: DataFrame, key: str):
    """Records of one dimension, its ranked lists and the concentration of its losses."""
    records = stage(search.records(rows, [key]), f"search-{key}")
    lists = {
        "losers": search.click_movers(records, figures, key, "loss"),
        "winners": search.click_movers(records, figures, key, "gain"),
        "visibility": search.visibility_losses(records, figures, key),
        "ctr": search.ctr_opportunities(records, figures, search.ctr_benchmarks(records), key),
        "ranking": search.ranking_opportunities(records, figures, key),
    }
    return records, lists, search.concentration(records, key, "loss")


def build(
    facts: DataFrame,
    settings: DataFrame,
    freshness: DataFrame,
    windows: Windows,
    search_type: str = "web",
    inspected: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All parts of the report by name. `settings` has property_id and brand_terms."""
    marked = mark(facts, windows)
    base = stage(search.rollup(marked, ROLLUP_DIMS), "search-rollup")
    main = base.filter(F.col("search_type") == search_type)
    totals = stage(search.two_sided(main, ["property_id"]), "search-totals")
    figures, kpis = search.property_figures(totals), stage(search.kpis_wide(totals), "search-kpis")
    daily = marked.filter((F.col("search_type") == search_type) & F.col("in_current")).groupBy(
        "property_id", "date").agg(
        F.sum("clicks").cast("double").alias("clicks"),
        F.sum("impressions").cast("double").alias("impressions"))
    daily = stage(daily, "search-daily")
    queries, query_lists, query_loss = dimension(main, figures, "query")
    pages, page_lists, page_loss = dimension(main, figures, "page")
    devices = search.devices(search.records(main, ["device"]))
    countries = search.countries(search.records(main, ["country"]))
    signals = search.cannibalisation(search.query_pages(main), figures)
    owners = search.owners(main)
    attribution, shape = search.decompose_clicks(kpis), timeseries.shape(daily)
    anomalies = timeseries.search_anomalies(daily)
    parts = [
        search_findings.kpi_findings(kpis, attribution, shape),
        search_findings.anomaly_findings(anomalies),
        search_findings.dimension_findings("query", query_lists, query_loss),
        search_findings.dimension_findings("page", page_lists, page_loss),
        search_findings.device_findings(devices),
        search_findings.country_findings(countries, kpis),
        search_findings.cannibal_findings(signals),
    ]
    if inspected is not None:
        parts.append(search_findings.indexing_findings(inspected))
    findings = stage(union_findings(parts), "search-findings")
    coverage = [
        search.reconciliation(records, totals).select(
            "property_id", F.lit(name).alias("dimension"), "coverage_pct")
        for name, records in (("query", queries), ("page", pages))
    ]
    long = long_kpis(kpis, SEARCH_KPIS, ["property_id"])
    surfaces = search.kpis_wide(
        search.two_sided(base.filter(F.col("search_type") != search_type),
                         ["property_id", "search_type"]), ("property_id", "search_type"))
    report = {
        "kpis": long,
        "headlines": quality.headline_kpis(long.drop("position"), HEADLINES["search"]),
        "surfaces": long_kpis(surfaces, SEARCH_KPIS, ["property_id", "search_type"]),
        "queries": queries, "pages": pages, "devices": devices, "countries": countries,
        "appearance": search.top_rows(
            search.records(main, ["appearance"]), "appearance", "impressions"),
        "top_queries": search.top_rows(queries, "query", "clicks"),
        "top_pages": search.top_rows(pages, "page", "clicks"),
        "attribution": attribution, "shape": shape, "anomalies": anomalies,
        "owners": owners, "cannibalisation": signals,
        "brand": search.brand_split(queries, settings),
        "inspection_targets": search.inspection_targets(pages),
        "findings": with_sentences(findings),
        "recommendations": search_findings.recommendations(
            query_lists, page_lists, findings, owners),
        "checks": quality.search_checks(
            kpis, freshness, coverage[0].unionByName(coverage[1]),
            settings.filter("size(brand_terms) > 0"), windows,
            appearances=main.filter("appearance IS NOT NULL")),
        "page_scatter": search.page_scatter(pages),
    }
    report |= {f"query_{name}": df for name, df in query_lists.items()}
    report |= {f"page_{name}": df for name, df in page_lists.items()}
    return report
