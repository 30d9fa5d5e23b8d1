"""Whole reports at the smallest scale: parts hang together and reach the sinks."""

import os

import pytest
from pyspark.sql import functions as F

from checks import views
from checks import web as web_queries
from tidemark.operators import periods, web_history
from tidemark.plans import ads_report, search_report, web_report, write
from tidemark.session import fresh_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def invariants(report):
    found = {(r["property_id"], r["id"]): r for r in report["findings"].collect()}
    assert found and all(r["evidence"] for r in found.values())
    lists = ("page_ctr_opportunities", "query_ctr_opportunities", "query_ranking_opportunities", "page_losses")
    for r in report["recommendations"].collect():
        assert (r["property_id"], r["from_finding"]) in found, r
        assert r["priority"] in ("High", "Medium", "Low") or r["from_finding"] in lists
    for r in report["kpis"].collect():
        for c in ("current", "previous", "absolute_change", "percent_change"):
            assert r[c] is None or r[c] - r[c] == 0
        assert not (r["previous"] == 0 and r["current"] and r["percent_change"] is not None)


def test_ads_report(spark, tmp_path):
    report = ads_report.build(views.ad_stats(spark, SF), views.campaign_dim(spark, SF), views.action_metadata(spark, SF),
                              views.YEAR_WINDOWS, "'USD'", {"keywords": (["campaign_id", "ad_group", "keyword"], 100)})
    invariants(report)
    write.write_report(report, str(tmp_path), "1999-12-31")
    documents = spark.read.json(f"{tmp_path}/documents")
    assert {r["kind"]: r["count"] for r in documents.groupBy("kind").count().collect()} == {
        "kpi": report["kpis"].count(), "finding": report["findings"].count(), "recommended_action": report["recommendations"].count()}
    assert documents.filter("kind = 'kpi'").groupBy("property_id").count().select("count").distinct().collect()[0][0] == 13


def test_search_report(spark):
    fresh = periods.freshness(views.search_stats(spark, SF), F.lit("1999-12-31").cast("date"))
    settings = views.table(spark, SF, "region").selectExpr("r_name AS property_id", "array('p1') AS brand_terms")
    report = search_report.build(views.search_stats(spark, SF), settings, fresh, views.YEAR_WINDOWS)
    invariants(report)
    assert report["surfaces"].filter("search_type = 'web'").isEmpty()


def test_web_report(spark):
    report = web_report.build(views.web_events(spark, SF), web_queries.definitions(spark, SF), views.EVENT_WINDOWS, min_sessions=5)
    invariants(report)
    # The same from kept first days and the events of the windows.
    path = fresh_path(spark, "first-seen")
    web_history.keep(views.web_events(spark, SF), path, views.EVENT_WINDOWS.cur_end)
    kept = web_report.build(views.web_events(spark, SF), web_queries.definitions(spark, SF), views.EVENT_WINDOWS, min_sessions=5, history=path)
    for part in ("kpis", "findings", "daily"):
        assert sorted(map(str, kept[part].collect())) == sorted(map(str, report[part].collect())), part
