"""Envelopes on disk to KPIs, with the three states of a dataset kept apart."""

import json

from pyspark.sql import functions as F

from tidemark.functions.catalog import ADS_KPIS, SEARCH_KPIS, WEB_KPIS
from tidemark.functions.compare import kpi_changes, long_kpis
from tidemark.functions.catalog import WEB_FLOORS, WEB_MATERIAL_PCT
from tidemark.operators import ads, ads_findings, quality, search
from tidemark.operators.findings import union_findings
from tidemark.sources import envelopes

PERIODS = {"current": {"start": "2026-07-20", "end": "2026-08-18", "days": 30},
           "previous": {"start": "2026-06-20", "end": "2026-07-19", "days": 30}}


def metrics(imp, clicks, cost, conv=None, value=None, **more):
    out = {"impressions": str(imp), "clicks": str(clicks), "costMicros": str(int(cost * 1e6))}
    if conv is not None:
        out["conversions"] = conv
    if value is not None:
        out["conversionsValue"] = value
    return {"metrics": {**out, **more}}


def campaign(cid, status="ENABLED", channel="SEARCH", **row):
    return {"campaign": {"id": cid, "name": f"Campaign {cid}", "status": status, "advertisingChannelType": channel}, **row}


def ads_doc(account, current, previous, campaigns=None, schema="ads/raw@1", **more):
    return {"schema": schema, "account": {"customer_id": account, "currency": "USD"}, "periods": PERIODS,
            "datasets": {"account_totals": {"current": current, "previous": previous},
                         "campaigns": campaigns or {"current": [], "previous": []}}, **more}


def load(spark, tmp_path, docs, schema):
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=2))
    return envelopes.read_envelopes(spark, str(tmp_path), schema)


def ads_frames(spark, tmp_path, docs):
    docs = load(spark, tmp_path, docs, envelopes.ADS_ENVELOPE).withColumn("property_id", F.col("account.customer_id"))
    facts = envelopes.ads_facts(envelopes.long_rows(docs, ["account_totals", "campaigns"]))
    totals = ads.account_totals(facts.filter("dataset = 'account_totals'"))
    return docs, facts, totals


def kpi_map(kpis, specs, account):
    rows = long_kpis(kpis, specs, ["property_id"]).filter(F.col("property_id") == account).collect()
    return {r["key"]: r for r in rows}


def test_gate(spark, tmp_path):
    docs = [ads_doc("ok", [], []), ads_doc("tag", [], [], schema="web/raw@1"), ads_doc("none", None, []),
            {**ads_doc("per", [], []), "periods": {"current": PERIODS["current"]}}]
    gated = envelopes.gate(load(spark, tmp_path, docs, envelopes.ADS_ENVELOPE), "ads/raw@1", "datasets.account_totals.current")
    got = {r["account"]["customer_id"]: r["reject_reason"] for r in gated.collect()}
    assert got == {"ok": None, "tag": "wrong schema tag", "none": "totals missing", "per": "periods missing"}


def test_dataset_states(spark, tmp_path):
    docs, _, _ = ads_frames(spark, tmp_path, [ads_doc("a", [metrics(1, 1, 1)], None)])
    got = {(r["dataset"], r["period"]): r["status"] for r in envelopes.dataset_status(docs, ["account_totals", "campaigns", "device"]).collect()}
    assert got == {("account_totals", "current"): "rows", ("account_totals", "previous"): "failed", ("campaigns", "current"): "empty",
                   ("campaigns", "previous"): "empty", ("device", "current"): "failed", ("device", "previous"): "failed"}
    checks = {r["check"]: r["status"] for r in quality.dataset_checks(envelopes.dataset_status(docs, ["account_totals"])).collect()}
    assert checks == {"account_totals (current)": "pass", "account_totals (previous)": "fail"}


def test_ads_cases(spark, tmp_path):
    docs = [
        ads_doc("zero", [metrics(1000, 300, 500, 22, 900)], [metrics(1000, 300, 400, 0, 0)]),
        ads_doc("novalue", [metrics(1000, 300, 500, 40)], [metrics(900, 290, 480, 38)]),
        ads_doc("placeholder", [metrics(1000, 300, 500, 40, 40)], [metrics(900, 290, 480, 38, 38)]),
        ads_doc("noconv", [metrics(1000, 300, 500, 0, 0)], [metrics(900, 290, 480, 12, 500)]),
        ads_doc("failed", [metrics(1000, 300, 500, 22, 900)], None),
    ]
    _, _, totals = ads_frames(spark, tmp_path, docs)
    kpis = ads.kpis_wide(totals).cache()
    zero = kpi_map(kpis, ADS_KPIS, "zero")
    assert (zero["conversions"]["verdict"], zero["conversions"]["percent_change"], zero["conversions"]["absolute_change"]) == ("new", None, 22.0)
    assert zero["cost_per_conversion"]["availability"] == "partial"
    novalue = kpi_map(kpis, ADS_KPIS, "novalue")
    assert novalue["roas"]["availability"] == "unavailable" and novalue["roas"]["current"] is None
    noconv = kpi_map(kpis, ADS_KPIS, "noconv")
    assert noconv["cost_per_conversion"]["current"] is None and noconv["roas"]["current"] == 0.0
    failed = kpi_map(kpis, ADS_KPIS, "failed")
    assert {failed[k]["verdict"] for k in ("cost", "clicks", "ctr")} == {"unknown"}
    silent = spark.createDataFrame([], "property_id string, silent bigint, names string")
    found = {(r["property_id"], r["id"]) for r in ads_findings.tracking_findings(kpis, silent).collect()}
    assert found == {("novalue", "no_conversion_value"), ("placeholder", "placeholder_conversion_value"), ("noconv", "no_conversions_recorded")}


def test_weighted_share_and_fallback(spark, tmp_path):
    share = lambda imp, v: metrics(imp, 10, 10, 1, 1, **({} if v is None else {"searchImpressionShare": v}))
    camps = {"current": [campaign("1", **share(3000, 0.6)), campaign("2", **share(1000, 0.2)), campaign("3", channel="VIDEO", **share(4000, None))],
             "previous": [campaign("1", **share(2000, 0.5))]}
    _, facts, totals = ads_frames(spark, tmp_path, [ads_doc("a", None, None, camps)])
    campaign_rows = ads.campaign_totals(facts.filter("dataset = 'campaigns'"))
    whole = ads.account_totals(facts.filter("dataset = 'campaigns'")).first()
    assert whole["cur_search_impression_share"] == 50.0
    cover = ads.share_coverage(campaign_rows).first()
    assert (cover["share_of_impressions"], cover["campaigns_reporting"], cover["campaigns_total"]) == (50.0, 2, 3)
    backed = ads.totals_with_fallback(totals, campaign_rows).first()
    assert backed["from_campaigns"] and float(backed["cur_cost"]) == 30.0
    present = {r["campaign_id"]: r["present_in"] for r in campaign_rows.collect()}
    assert present == {"1": "both", "2": "current only", "3": "current only"}


def test_sparse_campaigns_and_invariants(spark, tmp_path):
    camps = {"current": [campaign("1", status="PAUSED", **metrics(100, 40, 300, 0, 0)), campaign("2", **metrics(9000, 900, 700, 90, 9000))],
             "previous": [campaign("2", **metrics(9000, 850, 600, 80, 8000)), campaign("9", **metrics(10, 1, 5, 0, 0))]}
    docs = [ads_doc("a", [metrics(9100, 940, 1000, 90, 9000)], [metrics(9010, 851, 605, 80, 8000)], camps)]
    _, facts, totals = ads_frames(spark, tmp_path, docs)
    kpis = ads.kpis_wide(totals)
    attributes = envelopes.last_per_key(facts.filter("dataset = 'campaigns'"), ["property_id", "campaign_id"]).select(
        "property_id", "campaign_id", "name", "status", "channel_type", "bidding_strategy", "daily_budget").distinct()
    table = ads.campaign_table(ads.campaign_totals(facts.filter("dataset = 'campaigns'")), kpis, attributes)
    flags = {r["campaign_id"]: set(r["flags"]) for r in table.collect()}
    assert flags["1"] == {"sparse_data", "spend_no_conversions", "paused_but_spent"}
    found = union_findings([ads_findings.account_findings(kpis, "'USD'"), ads_findings.campaign_findings(table, "'USD'")]).cache()
    rows = {r["id"]: r for r in found.collect()}
    assert (rows["campaign_no_conversions:1"]["severity"], rows["campaign_no_conversions:1"]["confidence"]) == ("low", "low")
    assert "campaign_stopped:9" in rows and "campaign_new:1" in rows
    assert all(r["evidence"] for r in rows.values())
    recs = ads_findings.recommendations(found).collect()
    assert recs and {r["from_finding"] for r in recs} <= set(rows)
    assert {r["action"] for r in recs if r["from_finding"] == "campaign_no_conversions:1"} == {"Give Campaign 1 a test window and a decision date"}
    for r in long_kpis(kpis, ADS_KPIS, ["property_id"]).collect():
        assert not (r["previous"] == 0 and r["current"] != 0 and r["percent_change"] is not None)
        for c in ("current", "previous", "absolute_change", "percent_change"):
            assert r[c] is None or abs(r[c]) != float("inf") and r[c] == r[c]


def report(totals, rows=()):
    return {"totals": totals, "rows": [{"keys": k, "values": v} for k, v in rows], "meta": {}}


def test_web_envelope(spark, tmp_path):
    doc = {"schema": "web/raw@1", "property": {"property_id": "123456789"}, "periods": PERIODS,
           "datasets": {"totals": {"current": report({"sessions": 2000.0, "conversions": 40.0, "engagementRate": 0.55}), "previous": report(None)},
                        "channels": {"current": report(None, [(["Direct", "x"], {"sessions": 20.0, "sessionConversionRate": 0.25})]), "previous": None}}}
    docs = load(spark, tmp_path, [doc], envelopes.WEB_ENVELOPE).withColumn("property_id", F.col("property.property_id"))
    totals = docs.select("property_id", *[envelopes.report_totals(F.col(f"datasets.totals.{p}")).alias(p) for p in ("current", "previous")])
    specs = [k for k in WEB_KPIS if k.key in ("sessions", "keyEvents", "engagementRate")]
    wide = totals.select("property_id", *[F.try_element_at(p, F.lit(k.key)).alias(f"{n}_{k.key}") for k in specs for p, n in (("current", "cur"), ("previous", "prev"))])
    kpis = {r["key"]: r for r in long_kpis(kpi_changes(wide, specs, WEB_FLOORS, WEB_MATERIAL_PCT), specs, ["property_id"]).collect()}
    assert kpis["engagementRate"]["current"] == 0.55 * 100 and kpis["keyEvents"]["current"] == 40.0
    assert {k["verdict"] for k in kpis.values()} == {"unknown"}
    rows = envelopes.web_metrics(envelopes.long_rows(docs, ["channels"], ".rows"), ["sessions", "sessionKeyEventRate", "newUsers"]).collect()
    assert [(r["key"], r["sessions"], r["sessionKeyEventRate"], r["newUsers"]) for r in rows] == [("Direct / x", 20.0, 25.0, None)]


def test_search_envelope(spark, tmp_path):
    row = lambda q, c, i, p: {"query": q, "clicks": c, "impressions": i, "ctr": c / i, "position": p}
    period = lambda rows: {"rows": rows, "meta": {"rows_returned": len(rows), "truncated": False}}
    base = {"schema": "search/raw@1", "periods": PERIODS, "search_type": "web", "data_state": "final"}
    docs = [
        {**base, "property": {"site_url": "decline"}, "datasets": {
            "totals": {"current": period([row(None, 4100, 210000, 9.8)]), "previous": period([row(None, 5900, 206000, 9.9)])},
            "queries": {"current": period([row("a", 900, 30000, 3.0), row("b", 10, 4000, 8.0)]), "previous": period([row("a", 1500, 30000, 3.0), row("gone", 50, 900, 5.0)])}}},
        {**base, "property": {"site_url": "fresh"}, "datasets": {"totals": {"current": period([row(None, 310, 9000, 12.0)]), "previous": period([])}}},
        {**base, "property": {"site_url": "tiny"}, "datasets": {"totals": {"current": period([row(None, 13, 400, 12.0)]), "previous": period([row(None, 9, 390, 12.1)])}}},
    ]
    frame = load(spark, tmp_path, docs, envelopes.SEARCH_ENVELOPE).withColumn("property_id", F.col("property.site_url"))
    facts = envelopes.search_facts(envelopes.long_rows(frame, ["totals", "queries"], ".rows"))
    kpis = search.kpis_wide(search.two_sided(facts.filter("dataset = 'totals'"), ["property_id"])).cache()
    decline = kpi_map(kpis, SEARCH_KPIS, "decline")
    assert (decline["clicks"]["verdict"], decline["ctr"]["verdict"], decline["average_position"]["verdict"]) == ("declined", "declined", "flat")
    split = search.decompose_clicks(kpis).filter("property_id = 'decline'").first()
    assert split["dominant_factor"] == "ctr" and split["actual_click_change"] == -1800
    assert {r["verdict"] for r in kpi_map(kpis, SEARCH_KPIS, "fresh").values()} == {"new"}
    tiny = kpi_map(kpis, SEARCH_KPIS, "tiny")
    assert (tiny["clicks"]["verdict"], tiny["clicks"]["absolute_change"], tiny["impressions"]["verdict"]) == ("flat", 4.0, "flat")
    recs = {r["query"]: r for r in search.records(facts.filter("dataset = 'queries'"), ["query"]).collect()}
    assert recs["gone"]["present_in"] == "previous only" and recs["gone"]["clicks"] is None and recs["gone"]["clicks_change"] is None
    assert recs["a"]["clicks_change"] == -600 and recs["a"]["position_moved"] == "flat" and recs["a"]["band"] == "1-3"
