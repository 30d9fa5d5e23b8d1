"""Registered queries for scalar functions, sources, sinks, checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, display, nulls, text
from tidemark.functions.catalog import ADS_KPIS, HEADLINES
from tidemark.functions.compare import long_kpis
from tidemark.operators import ads, ads_findings, aggregate, periods, quality, search, timeseries, web
from tidemark.operators.findings import with_lines
from tidemark.session import fresh_path
from tidemark.sources import envelopes, exports, files
from tidemark.streaming import events as streams

from . import ads as ads_checks_
from . import search as search_checks_
from . import sqlgen as g
from . import web as web_checks_
from .views import (
    AD_SQL, EVENT_SQL, EVENT_WINDOWS, LEDGER_SQL, YEAR_WINDOWS, ad_stats, booked_receipts, table, web_events,
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


def orders(spark, sf):
    return table(spark, sf, "orders")


# --- numbers --------------------------------------------------------------------------------

@register("p1_to_number", """SELECT o_orderkey AS k, try_cast(CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS DOUBLE) AS number,
  try_cast(CASE WHEN o_orderkey % 4 = 1 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS BIGINT)::DOUBLE AS whole FROM orders""")
def p1_to_number(spark, sf):
    t = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE o_orderkey || '.5' END"
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("k"), nulls.to_number(F.expr(t)).alias("number"),
        nulls.to_count(F.expr("IF(o_orderkey % 4 = 1, 'x', CAST(o_orderkey AS STRING))")).cast("double").alias("whole"))


@register("p2_p3_p4_p5_p9_safe_math", f"""SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey * 1234)::DOUBLE / 1000000.0 AS money,
  {g.div('l_suppkey', 'l_linenumber - 1')} AS ratio, CASE WHEN l_linenumber = 2 THEN l_partkey WHEN l_linenumber = 3 THEN l_suppkey ELSE l_partkey + l_suppkey END::DOUBLE AS added,
  {g.div('l_suppkey', 'l_partkey')} * 100.0 AS percent, {g.rnd(g.div('l_suppkey', 'l_partkey') + ' * 100.0', 2)} AS rounded FROM lineitem""")
def p2_safe_math(spark, sf):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    share = nulls.pct(nulls.safe_div(b, a))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), nulls.micros_to_currency(a * 1234).alias("money"),
        nulls.safe_div(b, F.col("l_linenumber") - 1).alias("ratio"),
        nulls.null_add(F.expr("IF(l_linenumber = 3, NULL, l_partkey)"), F.expr("IF(l_linenumber = 2, NULL, l_suppkey)")).cast("double").alias("added"),
        share.alias("percent"), nulls.rnd(share, 2).alias("rounded"))


@register("a01_null_keeping_sums", """SELECT l_suppkey AS s, sum(CASE WHEN l_suppkey % 3 <> 0 AND l_linenumber > 2 THEN l_partkey END)::DOUBLE AS total,
  count(CASE WHEN l_suppkey % 3 <> 0 AND l_linenumber > 2 THEN l_partkey END) AS contributing, count(*) AS rows FROM lineitem GROUP BY 1""")
def a01_null_keeping_sums(spark, sf):
    v = F.expr("IF(l_suppkey % 3 <> 0 AND l_linenumber > 2, l_partkey, NULL)")
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(
        F.sum(v).cast("double").alias("total"), F.count(v).alias("contributing"), F.count("*").alias("rows"))


@register("p10_position_band", f"""SELECT l_orderkey AS k, l_linenumber AS n, {search_checks_.band_sql("CAST(CAST(l_tax AS DECIMAL(4,2)) * 275 AS DOUBLE)")} AS band FROM lineitem""")
def p10_position_band(spark, sf):
    p = "CAST(CAST(l_tax AS DECIMAL(4,2)) * 275 AS DOUBLE)"
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", f"{search.band_sql(p)} AS band")


@register("p08_derived_web_ratios", g.with_(AD_SQL) + f""", t AS (SELECT property_id, sum(impressions)::DOUBLE AS ev, sum(clicks)::DOUBLE AS ses, sum(conversions)::DOUBLE AS users,
  max(campaign_id) % 2 = 0 AS given FROM ad GROUP BY 1)
SELECT property_id, {g.div('ev', 'ses')} AS "eventsPerSession", CASE WHEN given THEN 1.5::DOUBLE ELSE {g.div('ev', 'ses')} END AS "screenPageViewsPerSession",
  {g.div('ses', 'users')} AS "sessionsPerUser", concat_ws(',', CASE WHEN ses <> 0 THEN 'eventsPerSession' END, CASE WHEN NOT given AND ses <> 0 THEN 'screenPageViewsPerSession' END,
  CASE WHEN users <> 0 THEN 'sessionsPerUser' END) AS derived FROM t""")
def p08_derived_web_ratios(spark, sf):
    t = ad_stats(spark, sf).groupBy("property_id").agg(
        F.sum("impressions").alias("eventCount"), F.sum("impressions").alias("screenPageViews"), F.sum("clicks").alias("sessions"),
        F.sum("conversions").alias("totalUsers"), F.expr("IF(max(campaign_id) % 2 = 0, 1.5D, NULL)").alias("screenPageViewsPerSession"),
        F.lit(None).cast("double").alias("sessionsPerUser"))
    return web.derive_missing(t).select("property_id", "eventsPerSession", "screenPageViewsPerSession", "sessionsPerUser",
                                        F.array_join("derived", ",").alias("derived"))


# --- text -----------------------------------------------------------------------------------

@register("p11_short_url", """SELECT page_id, CASE WHEN regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) END
  || CASE WHEN strpos(u, '?') > 0 THEN '?' || substr(u, strpos(u, '?') + 1) ELSE '' END AS path FROM (SELECT page_id, split_part(url, '#', 1) AS u FROM pages)""")
def p11_short_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.short_url(F.col("url")).alias("path"))


@register("p12_truncate", """SELECT page_id, CASE WHEN length(url) <= 34 THEN url ELSE substr(url, 1, 33) || '…' END AS label FROM pages""")
def p12_truncate(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.truncate(F.col("url"), 34).alias("label"))


@register("p13_p14_p34_dates", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_group, strftime(o_orderdate, '%b %-d, %Y') AS long_text,
  strftime(o_orderdate, '%b %-d') AS short_text FROM orders""")
def p13_dates(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("k"),
        dates.compact_date(F.expr("IF(o_orderkey % 9 = 0, 'unknown', date_format(o_orderdate, 'yyyyMMdd'))")).alias("iso"),
        dates.day_group(d).alias("day_group"), dates.display_date(d).alias("long_text"), dates.display_date(d, "short").alias("short_text"))


@register("p18_p36_default_labels", """SELECT CASE WHEN l_linenumber = 1 OR l_linenumber = 2 THEN 'UNSPECIFIED' ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1""")
def p18_default_labels(spark, sf):
    raw = F.expr("CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN NULL ELSE l_returnflag END")
    return table(spark, sf, "lineitem").groupBy(nulls.label_or(raw, "UNSPECIFIED").alias("label")).agg(F.count("*").alias("n"))


_DEC = "CASE WHEN v = floor(v) OR abs(v) >= 100 THEN format('{:,.0f}', v) WHEN abs(v) >= 10 THEN format('{:,.1f}', v) ELSE format('{:,.2f}', v) END"


@register("p19_p20_display", f"""SELECT k, format('£{{:,.2f}}', v) AS money, format('{{:,.2f}}%', v) AS rate, format('{{:,.0f}}', v) AS whole, {_DEC} AS dec,
  CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
    ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration,
  replace(CASE WHEN v * 100 >= 1e6 THEN format('{{:.1f}}M', v * 100 / 1e6::DOUBLE) WHEN v * 100 >= 1e3 THEN format('{{:.1f}}k', v * 100 / 1e3::DOUBLE) ELSE format('{{:,.0f}}', v * 100) END, '.0' || CASE WHEN v * 100 >= 1e6 THEN 'M' ELSE 'k' END,
    CASE WHEN v * 100 >= 1e6 THEN 'M' ELSE 'k' END) AS compact,
  CASE WHEN v > 500 THEN '+' ELSE '' END || format('{{:.1f}}%', v - 500) AS signed
FROM (SELECT o_orderkey AS k, (o_orderkey * 37 % 100003)::DOUBLE / 8.0 AS v, o_orderkey * 37 % 7919 AS s FROM orders)""")
def p19_display(spark, sf):
    o = orders(spark, sf).selectExpr("o_orderkey AS k", "CAST(o_orderkey * 37 % 100003 AS DOUBLE) / 8.0D AS v", "CAST(o_orderkey * 37 % 7919 AS DOUBLE) AS s",
                                     "CAST(o_orderkey * 37 % 100003 AS DOUBLE) / 8.0D * 100 AS big", "CAST(o_orderkey * 37 % 100003 AS DOUBLE) / 8.0D - 500 AS diff")
    return o.selectExpr("k", f"{display.value_text('v', 'currency', chr(39) + 'GBP' + chr(39))} AS money", f"{display.value_text('v', 'rate')} AS rate",
                        f"{display.value_text('v', 'int')} AS whole", f"{display.value_text('v', 'decimal')} AS dec", f"{display.duration('s')} AS duration",
                        f"{display.compact_number('big')} AS compact", f"{display.percent_text('diff')} AS signed")


_MONEY = "CASE WHEN {x} IS NULL THEN 'not available' ELSE format('{{:,.2f}}', {x}) END"


@register("p21_evidence_lines", g.with_(*ads_checks_.KPI_WIDE) + """
SELECT property_id, 'Clicks: ' || CASE clicks_avail WHEN 'unavailable' THEN 'not available' ELSE format('{:,.0f}', clicks_cur) || ' vs ' || format('{:,.0f}', clicks_prev) || ' (' ||
  CASE WHEN clicks_abs > 0 THEN '+' ELSE '' END || format('{:,.0f}', clicks_abs) || ', ' || CASE WHEN clicks_pct > 0 THEN '+' ELSE '' END || format('{:.1f}%', clicks_pct) || ')' END AS clicks_line,
  'CPA: ' || CASE cost_per_conversion_avail WHEN 'unavailable' THEN 'not available' ELSE format('{:,.2f}', cost_per_conversion_cur) || ' vs ' || format('{:,.2f}', cost_per_conversion_prev) || ' (' ||
  CASE WHEN cost_per_conversion_abs > 0 THEN '+' ELSE '-' END || format('{:,.2f}', abs(cost_per_conversion_abs)) || ', ' || CASE WHEN cost_per_conversion_pct > 0 THEN '+' ELSE '' END
  || format('{:.1f}%', cost_per_conversion_pct) || ')' END AS cpa_line FROM kw""")
def p21_evidence_lines(spark, sf):
    k = with_lines(ads_checks_.kpi_row(spark, sf), [s for s in ADS_KPIS if s.key in ("clicks", "cost_per_conversion")])
    return k.select("property_id", F.col("e_clicks").alias("clicks_line"), F.col("e_cost_per_conversion").alias("cpa_line"))


_ADSID = "CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '1') || '-456-7890' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE '123-45' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') END"
_WEBID = "CASE o_orderkey % 6 WHEN 0 THEN 'properties/' || (100000000 + o_orderkey) WHEN 1 THEN 'G-ABC' || o_orderkey WHEN 2 THEN 'UA-' || o_orderkey || '-1' WHEN 3 THEN 'GTM-X' || o_orderkey WHEN 4 THEN 'none' ELSE '12' END"


@register("p22_property_ids", f"""SELECT k, CASE WHEN length(a) = 10 THEN a END AS ads_id, CASE WHEN k % 6 = 0 THEN CAST(100000000 + k AS VARCHAR) END AS web_id,
  CASE k % 6 WHEN 1 THEN 'measurement id' WHEN 2 THEN 'retired property kind' WHEN 3 THEN 'tag container id' WHEN 4 THEN 'no digits' WHEN 5 THEN 'wrong length' END AS reject
FROM (SELECT o_orderkey AS k, regexp_replace({_ADSID}, '[^0-9]', '', 'g') AS a FROM orders)""")
def p22_property_ids(spark, sf):
    o = orders(spark, sf).select(F.col("o_orderkey").alias("k"), F.expr(_ADSID.replace("VARCHAR", "STRING")).alias("a"), F.expr(_WEBID).alias("w"))
    return o.select("k", text.ads_account_id(F.col("a")).alias("ads_id"), text.web_property_id(F.col("w")).alias("web_id"),
                    text.web_property_reject(F.col("w")).alias("reject"))


@register("p23_site_urls", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'sc-domain:' || h WHEN 1 THEN u || CASE WHEN u LIKE '%/' THEN '' ELSE '/' END END AS site,
  CASE page_id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'url_prefix' END AS kind, CASE WHEN page_id % 3 < 2 THEN h END AS shown
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS h, regexp_extract(url, '^([^?#]*)', 1) AS u FROM pages)""")
def p23_site_urls(spark, sf):
    raw = F.expr("""CASE page_id % 3 WHEN 0 THEN 'SC-Domain:' || upper(regexp_extract(url, '^[a-z]+://([^/]*)', 1)) || '/' WHEN 1 THEN ' "' || url || '" '
      ELSE regexp_extract(url, '^[a-z]+://([^/]*)', 1) END""")
    p = table(spark, sf, "pages").select("page_id", text.site_url(raw).alias("site"))
    return p.select("page_id", "site", text.site_kind(F.col("site")).alias("kind"), text.site_display(F.col("site")).alias("shown"))


@register("p25_p26_slugs_and_keys", """SELECT p_partkey AS k, rtrim(left(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), 12), '-') AS slug,
  regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS mk FROM (SELECT p_partkey, p_name || ' & Co. ' || p_brand AS t FROM part)""")
def p25_slugs(spark, sf):
    t = F.expr("p_name || ' & Co. ' || p_brand")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), text.slug(t, 12).alias("slug"), text.merchant_key(t).alias("mk"))


@register("p28_src11_file_inventory", """SELECT page_id, name, name LIKE '.%' AS hidden, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('jpg', 'gif') THEN 'image' WHEN ext = 'heic' THEN 'needs conversion'
  ELSE 'unrecognised format' END AS open_as FROM (SELECT page_id, (CASE WHEN page_id % 8 = 7 THEN '.' ELSE '' END) || 'f' || page_id || '.' || e AS name, lower(e) AS ext
  FROM (SELECT page_id, ['pdf', 'JPG', 'heic', 'docx', 'gif'][page_id % 5 + 1] AS e FROM pages)) WHERE page_id % 6 <> 5""")
def p28_file_inventory(spark, sf):
    paths = table(spark, sf, "pages").selectExpr("page_id", """'/c/accounting/receipts/' || IF(page_id % 6 = 5, '_processed-receipts/x/', '') || IF(page_id % 8 = 7, '.', '') || 'f' || page_id || '.'
      || array('pdf', 'JPG', 'heic', 'docx', 'gif')[page_id % 5] AS path""")
    return files.mark_files(paths).select("page_id", "name", "hidden", "open_as")


@register("p30_clean_merchant", """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'BLUE BOTTLE' || b WHEN 1 THEN 'Acme ' || c_mktsegment WHEN 2 THEN 'TESCO STORES' ELSE c_mktsegment || ' Works' END AS merchant
FROM (SELECT *, ' ' || lower(c_mktsegment) AS b FROM customer)""")
def p30_clean_merchant(spark, sf):
    raw = F.expr("""CASE c_custkey % 4 WHEN 0 THEN 'SQ *BLUE BOTTLE ' || lower(c_mktsegment) WHEN 1 THEN 'Acme ' || c_mktsegment || ', Ltd.'
      WHEN 2 THEN 'TESCO STORES ' || (1000 + c_custkey) || ' CARDIFF' ELSE c_mktsegment || ' Works GmbH' END""")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.clean_merchant(raw).alias("merchant"))


@register("p31_receipt_dates", """SELECT k, CAST(CASE WHEN k % 4 = 0 THEN d WHEN k % 4 = 3 THEN d WHEN day(d) > 12 OR day(d) = month(d) THEN d WHEN cur IN ('GBP', 'EUR') THEN d
    WHEN cur = 'USD' THEN make_date(year(d), day(d), month(d)) ELSE d END AS VARCHAR) AS date,
  k % 4 IN (1, 2) AND day(d) <= 12 AND day(d) <> month(d) AND cur = 'JPY' AS needs_review
FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, ['GBP', 'USD', 'EUR', 'JPY'][o_orderkey % 5 % 4 + 1] AS cur FROM orders)""")
def p31_receipt_dates(spark, sf):
    o = orders(spark, sf).selectExpr("o_orderkey AS k", """CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 3 THEN date_format(o_orderdate, 'd MMM yyyy')
      ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS t""", "array('GBP', 'USD', 'EUR', 'JPY')[o_orderkey % 5 % 4] AS cur")
    r = o.select("k", dates.resolve_receipt_date(F.col("t"), F.col("cur")).alias("r"))
    return r.select("k", F.col("r.date").cast("string").alias("date"), F.col("r.needs_review").alias("needs_review"))


# --- windows --------------------------------------------------------------------------------

@register("w1_w3_w4_w6_period_frame", """SELECT property_id, CAST(e AS VARCHAR) AS cur_end, CAST(e - 29 AS VARCHAR) AS cur_start, CAST(e - 30 AS VARCHAR) AS prev_end, CAST(e - 59 AS VARCHAR) AS prev_start,
  30 AS cur_days, true AS comparable, false AS overlapping, false AS partial_today, e - 59 < t - 480 AS beyond_retention
FROM (SELECT c_name AS property_id, CAST(max(o_orderdate) + CASE WHEN c_custkey % 2 = 0 THEN INTERVAL 30 HOUR ELSE INTERVAL 23 HOUR END AS DATE) AS t,
    CAST(max(o_orderdate) + CASE WHEN c_custkey % 2 = 0 THEN INTERVAL 30 HOUR ELSE INTERVAL 23 HOUR END AS DATE) - 3 AS e
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_custkey)""")
def w1_period_frame(spark, sf):
    joined = orders(spark, sf).join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    props = joined.groupBy(F.col("c_name").alias("property_id"), "c_custkey").agg(F.max("o_orderdate").alias("d")).withColumn(
        "today", periods.today_in_zone(F.expr("CAST(d AS TIMESTAMP) + INTERVAL '21' HOUR"),
                                       F.when(F.col("c_custkey") % 2 == 0, "Asia/Tokyo").otherwise("Etc/GMT-2")))
    f = periods.with_period_flags(periods.period_frame(props, 30, 2))
    return f.select("property_id", *[F.col(c).cast("string").alias(c) for c in ("cur_end", "cur_start", "prev_end", "prev_start")],
                    "cur_days", "comparable", "overlapping", "partial_today", "beyond_retention")


@register("w2_f1_windows_per_property", g.with_(AD_SQL) + """, b AS (SELECT n_name AS property_id, DATE '1999-06-30' - n_nationkey::INT AS e FROM nation)
SELECT property_id, sum(clicks) FILTER (date BETWEEN e - 89 AND e)::DOUBLE AS cur_clicks, sum(clicks) FILTER (date BETWEEN e - 149 AND e - 60)::DOUBLE AS prev_clicks,
  count(*) AS rows FROM ad JOIN b USING (property_id) WHERE date BETWEEN e - 149 AND e GROUP BY 1""")
def w2_windows_per_property(spark, sf):
    frame = table(spark, sf, "nation").selectExpr(
        "n_name AS property_id", "date_sub(DATE '1999-06-30', n_nationkey) AS cur_end").selectExpr(
        "property_id", "cur_end", "date_sub(cur_end, 89) AS cur_start", "date_sub(cur_end, 60) AS prev_end", "date_sub(cur_end, 149) AS prev_start")
    rows = periods.mark(ad_stats(spark, sf), frame)
    t = rows.groupBy("property_id").agg(F.sum(F.when(F.col("in_current"), F.col("clicks"))).cast("double").alias("cur_clicks"),
                                        F.sum(F.when(F.col("in_previous"), F.col("clicks"))).cast("double").alias("prev_clicks"), F.count("*").alias("rows"))
    return t


# --- sources --------------------------------------------------------------------------------

ENV_SQL = """acc AS (SELECT c_custkey AS k, 'acc-' || c_custkey AS property_id, coalesce(sum(o_orderkey % 1000) FILTER (year(o_orderdate) = 1999), 0) AS cur_n,
    count(o_orderkey) FILTER (year(o_orderdate) = 1999) AS cur_rows, count(o_orderkey) FILTER (year(o_orderdate) = 1998) AS prev_rows
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


def envelope_docs(spark, sf):
    """One JSON envelope per customer, parsed with the ads schema."""
    per = table(spark, sf, "customer").join(orders(spark, sf), F.expr("o_custkey = c_custkey"), "left").groupBy("c_custkey").agg(
        F.expr("coalesce(sum(IF(year(o_orderdate) = 1999, o_orderkey % 1000, 0)), 0)").alias("cur_n"),
        F.expr("count_if(year(o_orderdate) = 1999)").alias("cur_rows"), F.expr("count_if(year(o_orderdate) = 1998)").alias("prev_rows"))
    row = "named_struct('metrics', named_struct('impressions', CAST(cur_n AS STRING), 'clicks', IF(c_custkey % 4 = 0, 'bad', CAST(cur_rows AS STRING)), 'costMicros', CAST(cur_n * 1000000 AS STRING)))"
    text_ = per.selectExpr("c_custkey AS k", f"""to_json(named_struct('schema', IF(c_custkey % 7 = 3, 'other@1', 'ads/raw@1'), 'account', named_struct('customer_id', 'acc-' || c_custkey,
        'is_test_account', c_custkey % 50 = 1, 'is_manager', c_custkey % 50 = 2, 'status', IF(c_custkey % 50 = 3, 'SUSPENDED', 'ENABLED')),
      'periods', IF(c_custkey % 11 = 5, NULL, named_struct('current', named_struct('start', '1999-01-01', 'end', '1999-12-31', 'days', 365), 'previous', named_struct('start', '1998-01-01', 'end', '1998-12-31', 'days', 365))),
      'datasets', IF(c_custkey % 13 = 6, NULL, named_struct('account_totals', named_struct('current', IF(cur_rows > 0, array({row}), array()), 'previous', IF(c_custkey % 5 = 0, NULL, IF(prev_rows > 0, array({row}), array())))))
      )) AS doc""")
    return text_.select("k", F.from_json("doc", envelopes.ADS_ENVELOPE).alias("e")).select("k", "e.*").withColumn("property_id", F.col("account.customer_id"))


@register("src1_envelope_gate", g.with_(ENV_SQL) + """SELECT property_id, CASE WHEN k % 7 = 3 THEN 'wrong schema tag' WHEN k % 11 = 5 THEN 'periods missing' WHEN k % 13 = 6 THEN 'totals missing' END AS reject_reason FROM acc""")
def src1_envelope_gate(spark, sf):
    return envelopes.gate(envelope_docs(spark, sf), "ads/raw@1", "datasets.account_totals.current").select("property_id", "reject_reason")


@register("src2_d07_dataset_status", g.with_(ENV_SQL) + """SELECT property_id, 'account_totals' AS dataset, 'current' AS period, CASE WHEN k % 13 = 6 THEN 'failed' WHEN cur_rows = 0 THEN 'empty' ELSE 'rows' END AS status FROM acc
UNION ALL SELECT property_id, 'account_totals', 'previous', CASE WHEN k % 13 = 6 OR k % 5 = 0 THEN 'failed' WHEN prev_rows = 0 THEN 'empty' ELSE 'rows' END FROM acc""")
def src2_dataset_status(spark, sf):
    return envelopes.dataset_status(envelope_docs(spark, sf), ["account_totals"])


@register("src4_ads_rows", g.with_(ENV_SQL) + """SELECT property_id, 'current' AS period, cur_n::DOUBLE AS impressions, CASE WHEN k % 4 <> 0 THEN cur_rows END::DOUBLE AS clicks, cur_n::DOUBLE AS cost FROM acc WHERE k % 13 <> 6 AND cur_rows > 0
UNION ALL SELECT property_id, 'previous', cur_n, CASE WHEN k % 4 <> 0 THEN cur_rows END, cur_n FROM acc WHERE k % 13 <> 6 AND k % 5 <> 0 AND prev_rows > 0""")
def src4_ads_rows(spark, sf):
    facts = envelopes.ads_facts(envelopes.long_rows(envelope_docs(spark, sf), ["account_totals"]))
    return facts.select("property_id", "period", *[F.col(c).cast("double").alias(c) for c in ("impressions", "clicks", "cost")])


@register("d06_account_checks", g.with_(ENV_SQL) + """SELECT property_id, 'test account' AS check, 'fail' AS status FROM acc WHERE k % 50 = 1 UNION ALL SELECT property_id, 'manager account', 'fail' FROM acc WHERE k % 50 = 2
UNION ALL SELECT property_id, 'account status', 'warn' FROM acc WHERE k % 50 = 3""")
def d06_account_checks(spark, sf):
    return quality.account_checks(envelope_docs(spark, sf).select("property_id", "account.*")).select("property_id", "check", "status")


@register("src3_positional_report", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey::DOUBLE AS sessions, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_suppkey END::DOUBLE AS users,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS events FROM lineitem""")
def src3_positional_report(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "array('sessions', 'users', 'events') AS metric_headers",
        """IF(l_linenumber = 3, array(CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)), array(CAST(l_partkey AS STRING), IF(l_linenumber = 2, '', CAST(l_suppkey AS STRING)), CAST(l_quantity AS STRING))) AS metric_values""")
    return envelopes.positional_report(rows).select("k", "n", *[F.try_element_at("values", F.lit(m)).alias(m) for m in ("sessions", "users", "events")])


@register("src5_search_rows", """SELECT l_orderkey AS k, l_linenumber AS n, 'p' || l_partkey AS query, CASE WHEN l_linenumber <> 1 THEN 's' || l_suppkey END AS page, l_quantity AS clicks, l_tax AS position FROM lineitem""")
def src5_search_rows(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "IF(l_linenumber = 1, array('p' || l_partkey), array('p' || l_partkey, 's' || l_suppkey)) AS keys",
        "l_quantity AS clicks", "l_quantity AS impressions", "l_tax AS ctr", "l_tax AS position")
    return envelopes.search_row(rows, ["query", "page"]).select("k", "n", "query", "page", "clicks", "position")


SUPPORT = """sup AS (SELECT c_name AS property_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE list(DISTINCT m) END AS metrics FROM (SELECT c_custkey, c_name,
  ['keyEvents', 'sessionKeyEventRate', 'userKeyEventRate', 'conversions', 'sessionConversionRate', 'userConversionRate', 'landingPage', 'landingPagePlusQueryString'][o_orderkey % 8 + 1] AS m
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY c_name, c_custkey)"""


def support(spark, sf):
    names = "array('keyEvents', 'sessionKeyEventRate', 'userKeyEventRate', 'conversions', 'sessionConversionRate', 'userConversionRate', 'landingPage', 'landingPagePlusQueryString')"
    # A customer without orders has no key, and a negative key counts from the end, as in the twin; neither may fail the task.
    joined = table(spark, sf, "customer").join(orders(spark, sf), F.expr("o_custkey = c_custkey"), "left").withColumn(
        "m", F.expr(f"try_element_at({names}, CAST(nullif(o_orderkey % 8 + 1, 0) AS INT))"))
    return joined.groupBy(F.col("c_name").alias("property_id"), "c_custkey").agg(F.collect_set("m").alias("m")).select(
        "property_id", "c_custkey", F.expr("IF(c_custkey % 10 = 0, NULL, m)").alias("metrics"), F.expr("IF(c_custkey % 10 = 0, NULL, m)").alias("dimensions"))


@register("src6_metric_support", g.with_(SUPPORT) + """SELECT property_id, metric, metrics IS NULL OR list_contains(metrics, metric) AS supported,
  CASE WHEN metrics IS NOT NULL AND NOT list_contains(metrics, metric) THEN 'not in this property''s metric schema' END AS reason FROM sup, (SELECT unnest(['keyEvents', 'conversions', 'sessions']) AS metric)""")
def src6_metric_support(spark, sf):
    return envelopes.metric_support(support(spark, sf), ["keyEvents", "conversions", "sessions"])


@register("src7_src8_vocabularies", g.with_(SUPPORT) + """SELECT property_id, CASE WHEN metrics IS NULL OR list_contains(metrics, 'landingPagePlusQueryString') THEN 'landingPagePlusQueryString' WHEN list_contains(metrics, 'landingPage') THEN 'landingPage' END AS dimension,
  CASE WHEN metrics IS NULL OR list_has_all(metrics, ['keyEvents', 'sessionKeyEventRate', 'userKeyEventRate']) THEN 'keyEvents' WHEN list_has_all(metrics, ['conversions', 'sessionConversionRate', 'userConversionRate']) THEN 'conversions' END AS metric_naming FROM sup""")
def src7_vocabularies(spark, sf):
    # Customers may share a name: a row meets its own key only, or many of one name would multiply.
    s, key = support(spark, sf), ["property_id", "c_custkey"]
    naming = envelopes.key_event_vocabulary(s, key).withColumnsRenamed({"property_id": "_id", "c_custkey": "_key"})
    return envelopes.first_dimension(s, "landing_page", key).join(
        naming, (F.col("property_id") == F.col("_id")) & F.col("c_custkey").eqNullSafe(F.col("_key"))).select("property_id", "dimension", "metric_naming")


@register("p06_canonical_metrics", """SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS "keyEvents", l_tax * 100.0 AS "sessionKeyEventRate", l_discount * 100.0 AS "engagementRate" FROM lineitem""")
def p06_canonical_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), envelopes.canonical_metrics(
        F.expr("map('conversions', l_quantity, 'sessionConversionRate', l_tax, 'engagementRate', l_discount)")).alias("v"))
    return rows.select("k", "n", *[F.col(f"v.{m}").alias(m) for m in ("keyEvents", "sessionKeyEventRate", "engagementRate")])


@register("a28_report_totals", """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey END::DOUBLE AS sessions FROM orders""")
def a28_report_totals(spark, sf):
    report = F.expr("""named_struct('totals', IF(o_orderkey % 3 = 0, map('sessions', o_totalprice), NULL), 'rows', IF(o_orderkey % 3 = 2, CAST(array() AS ARRAY<STRUCT<keys: ARRAY<STRING>, values: MAP<STRING, DOUBLE>>>),
      array(named_struct('keys', array('x'), 'values', map('sessions', CAST(o_custkey AS DOUBLE))))))""")
    return orders(spark, sf).withColumn("r", report).select(F.col("o_orderkey").alias("k"),
                                                            F.try_element_at(envelopes.report_totals(F.col("r")), F.lit("sessions")).alias("sessions"))


SITEMAPS = """sm AS (SELECT o_orderkey AS k, sum(l_quantity) AS q, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
smx AS (SELECT k, CASE WHEN k % 10 = 0 THEN NULL ELSE q END AS submitted, CASE WHEN k % 3 = 0 THEN NULL ELSE n * 4 END::DOUBLE AS indexed, k % 4 = 0 AS pending, k % 5 = 0 AS erring, k % 6 <> 0 AS loaded FROM sm)"""


def sitemap_export(spark, sf):
    rows = orders(spark, sf).join(table(spark, sf, "lineitem"), F.expr("o_orderkey = l_orderkey")).groupBy("o_orderkey").agg(F.collect_list(F.expr(
        "named_struct('submitted', IF(o_orderkey % 10 = 0, 'x', CAST(CAST(l_quantity AS BIGINT) AS STRING)), 'indexed', IF(o_orderkey % 3 = 0, NULL, '4'))")).alias("contents"))
    return rows.selectExpr("'p' AS property_id", "o_orderkey AS path", "contents", "IF(o_orderkey % 6 <> 0, '2024-01-01', NULL) AS lastDownloaded",
                           "o_orderkey % 4 = 0 AS isPending", "'0' AS warnings", "IF(o_orderkey % 5 = 0, '2', '0') AS errors")


@register("src13_sitemaps", g.with_(SITEMAPS) + "SELECT k AS path, submitted, indexed FROM smx")
def src13_sitemaps(spark, sf):
    return envelopes.sitemaps(sitemap_export(spark, sf)).select("path", F.col("submitted").cast("double").alias("submitted"), F.col("indexed").cast("double").alias("indexed"))


@register("an18_sitemap_problems", g.with_(SITEMAPS) + """SELECT k AS path, 'reports errors' AS problem FROM smx WHERE erring UNION ALL SELECT k, 'pending' FROM smx WHERE pending
UNION ALL SELECT k, 'never downloaded' FROM smx WHERE NOT loaded AND NOT pending UNION ALL SELECT k, 'half or more not indexed' FROM smx WHERE submitted > 0 AND indexed / submitted < 0.5""")
def an18_sitemap_problems(spark, sf):
    return search.sitemap_problems(envelopes.sitemaps(sitemap_export(spark, sf))).select("path", "problem")


def inspected(spark, sf):
    rows = table(spark, sf, "pages").selectExpr("'p' AS property_id", "url", """to_json(named_struct('indexStatusResult', named_struct('verdict', IF(page_id % 2 = 0, 'PASS', 'NEUTRAL'), 'coverageState',
      IF(page_id % 3 = 0, 'Submitted and indexed', 'Crawled'), 'robotsTxtState', 'ALLOWED'), 'mobileUsabilityResult', named_struct('verdict', 'PASS'))) AS result""")
    return envelopes.index_status(rows)


@register("src14_index_status", """SELECT url, CASE WHEN page_id % 2 = 0 THEN 'PASS' ELSE 'NEUTRAL' END AS verdict, CASE WHEN page_id % 3 = 0 THEN 'Submitted and indexed' ELSE 'Crawled' END AS coverage_state,
  'ALLOWED' AS robots_txt_state, CAST(NULL AS VARCHAR) AS last_crawl_time FROM pages""")
def src14_index_status(spark, sf):
    return inspected(spark, sf).select("url", "verdict", "coverage_state", "robots_txt_state", "last_crawl_time")


@register("fs18_indexing_findings", """SELECT 'indexing:' || url AS id, 'high' AS severity, url AS entity FROM pages WHERE NOT (page_id % 2 = 0 AND page_id % 3 = 0)""")
def fs18_indexing_findings(spark, sf):
    from tidemark.operators.search_findings import indexing_findings
    return indexing_findings(inspected(spark, sf)).select("id", "severity", "entity")


@register("src12_reference_lists", """SELECT p_partkey AS k, p_type AS category FROM part WHERE p_partkey % 3 <> 0""")
def src12_reference_lists(spark, sf):
    lines = table(spark, sf, "part").selectExpr("p_partkey AS k", "IF(p_partkey % 3 = 0, '## ' || p_name, '| `' || p_type || '` | ' || p_name || ' |') AS value")
    return files.category_list(lines)


@register("j2_chunk_merge", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END::DOUBLE AS sessions, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice ELSE o_custkey END AS users FROM orders
WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0""")
def j2_chunk_merge(spark, sf):
    o = orders(spark, sf)
    first = o.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS k", "CAST(o_custkey AS DOUBLE) AS sessions", "CAST(o_custkey AS DOUBLE) AS users")
    second = o.filter("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS k", "o_totalprice AS users")
    return aggregate.rollup_merge([first, second], ["k"])[0]


@register("j2_stray_rows", "SELECT 2 AS part, count(*) AS stray_rows FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0")
def j2_stray_rows(spark, sf):
    o = orders(spark, sf)
    first = o.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS k", "CAST(o_custkey AS DOUBLE) AS sessions")
    return aggregate.rollup_merge([first, o.filter("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS k", "o_totalprice AS users")], ["k"])[1]


@register("win8_last_value", """SELECT l_suppkey AS s, l_linenumber AS n, max(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1, 2""")
def win8_last_value(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_suppkey AS s", "l_linenumber AS n", "l_orderkey * 10 + l_linenumber AS seq")
    return envelopes.last_per_key(rows, ["s", "n"]).distinct()


@register("p16_flatten_layouts", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'flat' ELSE 'nested' END AS property_id, CAST(o_orderdate AS VARCHAR)[:10] AS date, o_totalprice AS sessions, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END::DOUBLE AS users FROM orders""")
def p16_flatten_layouts(spark, sf):
    o = orders(spark, sf).withColumn("date", F.col("o_orderdate").cast("date"))
    flat = o.filter("o_orderkey % 2 = 0").selectExpr("'flat' AS property_id", "date", "o_totalprice AS sessions")
    nested = o.filter("o_orderkey % 2 = 1").selectExpr("'nested' AS property_id", "date", "map('sessions', o_totalprice, 'users', CAST(o_custkey AS DOUBLE)) AS values")
    return timeseries.flatten_layouts(flat, nested, ["sessions", "users"]).withColumn("date", F.col("date").cast("string"))


# --- sinks ----------------------------------------------------------------------------------

def _cell(x):
    return f"CASE WHEN {x} IS NULL THEN '' WHEN abs({x} - round_even({x}, 0)) < 1e-9 THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) ELSE format('{{:.4f}}', {x}) END"


@register("snk3_snk4_segment_csv", g.with_(*web_checks_.SEGS) + "SELECT property_id, key AS channel, " + ", ".join(
    f"{_cell(f'{p}{m}')} AS {long}_{m}" for p, long in (("cur_", "current"), ("prev_", "previous")) for m in ("sessions", "engagementRate", "totalRevenue")) + " FROM seg WHERE dataset = 'channels'")
def snk3_segment_csv(spark, sf):
    s = web_checks_.segments(spark, sf, {"channels": "channel"})
    return exports.segment_csv(s, "channel", ["sessions", "engagementRate", "totalRevenue"])


@register("snk5_daily_csv", g.with_(*web_checks_.SESS, web_checks_.DAILY, web_checks_.CAL) + f"""SELECT property_id, CAST(date AS VARCHAR) AS date, CASE WHEN sessions IS NULL THEN 'no' ELSE 'yes' END AS data_returned,
  {_cell('sessions')} AS sessions, {_cell('"totalRevenue"')} AS "totalRevenue" FROM cal LEFT JOIN wd USING (property_id, period, date) WHERE period = 'current'""")
def snk5_daily_csv(spark, sf):
    d = timeseries.on_calendar(web_checks_.days(spark, sf), web_checks_.daily(spark, sf)).filter("period = 'current'")
    return exports.daily_csv(d, ["sessions", "totalRevenue"])


@register("snk5_ecommerce_csv", g.with_(*web_checks_.KPIS, web_checks_.FUNNEL, web_checks_.LONG, web_checks_.breakdown_sql("property_id, dataset, key", "sl", "seg")) + f"""
SELECT property_id, 'funnel' AS kind, CASE key WHEN 'itemsViewed' THEN 'Items viewed' WHEN 'itemsAddedToCart' THEN 'Items added to cart' WHEN 'itemsCheckedOut' THEN 'Items checked out' ELSE 'Items purchased' END AS label,
  {_cell('current')} AS current_value, {_cell('previous')} AS previous_value, {_cell('step_rate_current')} AS current_secondary, {_cell('step_rate_previous')} AS previous_secondary FROM fun
UNION ALL SELECT property_id, 'channel', key, {_cell('"cur_totalRevenue"')}, {_cell('"prev_totalRevenue"')}, {_cell('cur_transactions')}, {_cell('prev_transactions')} FROM seg WHERE dataset = 'channels'""")
def snk5_ecommerce_csv(spark, sf):
    s = web_checks_.sessions(spark, sf)
    return exports.ecommerce_csv(web.funnel(web.kpis_wide(web.totals(s))), web.all_breakdowns(s, {"channels": "channel"}))


@register("snk1_snk2_kpi_documents", ads_checks_.ORACLE["c1_ads_kpis"].replace("SELECT property_id, position, key, label, unit, better AS better_when, c AS current, p AS previous,\n  absolute_change, percent_change, availability, direction, verdict, material FROM chg",
                                                                              "SELECT property_id, key, c AS current, verdict, material FROM chg"))
def snk1_kpi_documents(spark, sf):
    path = fresh_path(spark, "kpi-documents")
    kpis = long_kpis(ads_checks_.kpi_row(spark, sf), ADS_KPIS, ["property_id"]).select("property_id", "key", "current", "verdict", "material")
    found = ads_checks_.all_findings(spark, sf)
    actions = ads_findings.recommendations(found)
    exports.write_analysis(exports.analysis_documents(kpis, found, actions, "1999-12-31"), path)
    back = spark.read.schema("property_id string, kind string, item string").json(path).filter("kind = 'kpi'")
    return back.select("property_id", F.from_json("item", "key string, current double, verdict string, material boolean").alias("i")).select("property_id", "i.*")


@register("snk6_ledger_append", g.with_(LEDGER_SQL) + "SELECT client, line, gross_amount::DOUBLE AS gross_amount, CASE WHEN purchase_date < DATE '2000-01-01' THEN 'run-1' ELSE 'run-2' END AS run_id FROM booked")
def snk6_ledger_append(spark, sf):
    path = fresh_path(spark, "ledger")
    rows = booked_receipts(spark, sf).select("client", "line", "gross_amount", "purchase_date")
    for run, cond in (("run-1", "purchase_date < DATE '2000-01-01'"), ("run-2", "purchase_date >= DATE '2000-01-01'"), ("run-2", "purchase_date >= DATE '2000-01-01'")):
        exports.append_ledger(rows.filter(cond), path, run)
    return spark.read.parquet(path).select("client", "line", F.col("gross_amount").cast("double").alias("gross_amount"), "run_id")


@register("snk9_run_log", g.with_(LEDGER_SQL) + "SELECT 'run-1' AS run_id, client, '' AS channel, count(*) AS receipts_logged, count(*) FILTER (confidence < 0.70) AS needs_review_count, false AS posted FROM booked GROUP BY client")
def snk9_run_log(spark, sf):
    from tidemark.operators.ledger import run_summary
    rows = booked_receipts(spark, sf).withColumn("needs_review", F.expr("confidence < 0.70"))
    return exports.run_log(run_summary(rows), "run-1").drop("message")


@register("snk9_run_log_message", g.with_(LEDGER_SQL) + """, s AS (SELECT client, count(*) AS n, sum(gross_amount) AS total, any_value(CASE WHEN trim(currency) = '' THEN '???' ELSE upper(trim(currency)) END) AS cur
  FROM booked GROUP BY client)
SELECT client, run_id, n || ' receipts processed and logged — ' || CASE cur WHEN 'GBP' THEN '£' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE '' END
  || format('{:,.2f}', total::DOUBLE) || CASE cur WHEN '???' THEN ' ???' ELSE '' END || ' total.' AS message FROM s, (VALUES ('run-1'), ('run-2')) AS r(run_id)""")
def snk9_run_log_message(spark, sf):
    """Two runs, the second written twice."""
    from tidemark.operators.ledger import run_summary
    path = fresh_path(spark, "run-log")
    summary = run_summary(booked_receipts(spark, sf).withColumn("needs_review", F.expr("confidence < 0.70")))
    for run in ("run-1", "run-2", "run-2"):
        exports.append_run_log(summary, path, run)
    return spark.read.json(path).select("client", "run_id", "message")


@register("snk7_archive_append", g.with_(LEDGER_SQL) + """SELECT client, strftime(purchase_date, '%Y%m_%B') AS folder, count(*) AS files, min(file_path) AS first_path FROM booked GROUP BY 1, 2""")
def snk7_archive_append(spark, sf):
    path = fresh_path(spark, "archive")
    rows = booked_receipts(spark, sf).select("client", "file_path", text.archive_folder(F.col("purchase_date")).alias("folder"), "line")
    for run, cond in (("run-1", "line % 2 = 0"), ("run-2", "line % 2 = 1"), ("run-2", "line % 2 = 1")):
        exports.append_archive(rows.filter(cond), path, run)
    return spark.read.parquet(path).groupBy("client", "folder").agg(F.count("*").alias("files"), F.min("file_path").alias("first_path"))


@register("snk8_review_list_append", g.with_(LEDGER_SQL) + """SELECT client, count(*) AS open_items, min(file_path) AS first_path FROM booked WHERE confidence < 0.70 GROUP BY client""")
def snk8_review_list_append(spark, sf):
    from tidemark.operators.ledger import review_list
    path = fresh_path(spark, "review-list")
    rows = booked_receipts(spark, sf).withColumns({"needs_review": F.expr("confidence < 0.70"), "review_notes": F.lit("")})
    for run, cond in (("run-1", "line % 2 = 0"), ("run-2", "line % 2 = 1"), ("run-1", "line % 2 = 0")):
        exports.append_review_list(review_list(rows.filter(cond)), path, run)
    return spark.read.json(path).groupBy("client").agg(F.count("*").alias("open_items"), F.min("file_path").alias("first_path"))


@register("snk2_kpi_export", ads_checks_.ORACLE["c1_ads_kpis"].replace("SELECT property_id, position, key, label, unit, better AS better_when, c AS current, p AS previous,\n  absolute_change, percent_change, availability, direction, verdict, material FROM chg",
                                                                       "SELECT property_id, key, c AS current, p AS previous, verdict FROM chg"))
def snk2_kpi_export(spark, sf):
    path = fresh_path(spark, "kpis")
    kpis = long_kpis(ads_checks_.kpi_row(spark, sf), ADS_KPIS, ["property_id"]).select("property_id", "key", "current", "previous", "verdict")
    for _ in range(2):
        exports.write_kpis(kpis, path, "1999-12-31")
    return spark.read.schema("property_id string, key string, current double, previous double, verdict string").json(path).drop("period_end")


@register("snk5_events_csv", g.with_(*web_checks_.EVT) + f"""SELECT property_id, event_name, CASE WHEN is_key_event THEN 'yes' ELSE 'no' END AS is_key_event,
  {_cell('c')} AS current_event_count, {_cell('p')} AS previous_event_count, {_cell('cur_key::DOUBLE')} AS current_key_events, {_cell('cur_users::DOUBLE')} AS current_total_users FROM evt""")
def snk5_events_csv(spark, sf):
    path = fresh_path(spark, "events-csv")
    exports.write_csv(exports.events_csv(web_checks_.events_table(spark, sf)), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).na.fill("")


@register("src9_src10_ledger_csv", g.with_(LEDGER_SQL) + """SELECT merchant, CAST(purchase_date AS VARCHAR) AS purchase_date, gross_amount::DOUBLE AS gross_amount, receipt_number, confidence < 0.70 AS needs_review,
  CASE WHEN line % 2 = 0 THEN 'a, "b"' ELSE 'plain' END AS review_notes, file_path, strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at FROM booked""")
def src9_src10_ledger_csv(spark, sf):
    """The ledger as a CSV file with its fixed header: the header is checked, then the rows are read."""
    path = fresh_path(spark, "ledger-csv")
    booked_receipts(spark, sf).selectExpr(
        "merchant", "purchase_date", "currency", "gross_amount", "CAST(0 AS DECIMAL(18,2)) AS tax_amount", "gross_amount AS net_amount", "receipt_number", "category",
        "confidence", "IF(confidence < 0.70, 'yes', 'no') AS needs_review", "IF(line % 2 = 0, 'a, \"b\"', 'plain') AS review_notes", "file_path",
        "date_format(processed_at, \"yyyy-MM-dd'T'HH:mm:ss\") AS processed_at").write.option("header", True).option("escape", '"').csv(path)
    return files.read_ledger(spark, path).select(
        "merchant", F.col("purchase_date").cast("string").alias("purchase_date"), F.col("gross_amount").cast("double").alias("gross_amount"),
        F.coalesce("receipt_number", F.lit("")).alias("receipt_number"), "needs_review", "review_notes", "file_path", F.col("processed_at").cast("string").alias("processed_at"))


@register("src11_inventory", """SELECT c_mktsegment AS segment, 'unrecognised format' AS open_as, false AS hidden FROM customer GROUP BY 1""")
def src11_inventory(spark, sf):
    """Files that Spark wrote, one folder per market segment, listed without opening them."""
    path = fresh_path(spark, "inventory")
    table(spark, sf, "customer").select("c_mktsegment", "c_name").repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    listed = files.inventory(spark, path).filter("length > 0")
    return listed.select(F.url_decode(F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)).alias("segment"), "open_as", "hidden").distinct()


@register("src12_vendor_list", "SELECT s_name AS vendor FROM supplier WHERE s_suppkey % 3 <> 2")
def src12_vendor_list(spark, sf):
    lines = table(spark, sf, "supplier").selectExpr("CASE s_suppkey % 3 WHEN 0 THEN '- ' || s_name WHEN 1 THEN '  ' || s_name || ' ' ELSE '# ' || s_name END AS value")
    return files.vendor_list(lines)


# --- quality --------------------------------------------------------------------------------

@register("d01_d02_d03_d05_d19_ads_checks", g.with_(*ads_checks_.CAMP, f"t0 AS (SELECT property_id, {g.two(ads_checks_.BASE)} FROM adw GROUP BY property_id)", """
cs AS (SELECT property_id, count(*) FILTER (cur_clicks < 100) AS sparse, coalesce(sum(cur_impression_share_den), 0) AS cov, count(cur_impression_share_den) AS rep, sum(cur_impressions) AS imp FROM camp GROUP BY 1),
dr AS (SELECT property_id, count(DISTINCT date) FILTER (in_current) AS cd, count(DISTINCT date) FILTER (in_previous) AS pd FROM adw GROUP BY 1)""") + f"""
SELECT property_id, 'equal periods' AS check, 'pass' AS status FROM t0 UNION ALL SELECT property_id, 'campaign spend reconciles (current)', 'pass' FROM t0 UNION ALL SELECT property_id, 'campaign spend reconciles (previous)', 'pass' FROM t0
UNION ALL SELECT property_id, 'daily coverage (current)', 'fail' FROM dr WHERE cd > 0 AND cd < 365 UNION ALL SELECT property_id, 'daily coverage (previous)', 'fail' FROM dr WHERE pd > 0 AND pd < 365
UNION ALL SELECT property_id, 'impression share coverage', 'warn' FROM cs WHERE {g.rnd('100.0::DOUBLE * ' + g.div('cov', 'imp'), 1)} < 90 AND rep > 0
UNION ALL SELECT property_id, 'campaigns too small', 'warn' FROM cs WHERE sparse > 0 UNION ALL SELECT property_id, 'account sample size', 'warn' FROM t0 WHERE cur_conversions < 30""")
def d01_ads_checks(spark, sf):
    rows = ads_checks_.marked(spark, sf)
    totals, camp = ads.account_totals(rows), ads.campaign_totals(rows)
    return quality.ads_checks(ads.kpis_wide(totals), totals, camp, ads.daily(rows), ads.share_coverage(camp), YEAR_WINDOWS).select("property_id", "check", "status")


@register("a18_days_returned", g.with_(AD_SQL) + "SELECT property_id, count(DISTINCT date) FILTER (in_current) AS cur_days, count(DISTINCT date) FILTER (in_previous) AS prev_days FROM adw GROUP BY 1")
def a18_days_returned(spark, sf):
    return ads.daily(ads_checks_.marked(spark, sf)).groupBy("property_id").agg(
        F.count_distinct(F.expr("if(period = 'current', date, null)")).alias("cur_days"), F.count_distinct(F.expr("if(period = 'previous', date, null)")).alias("prev_days"))


@register("d04_unavailable_metrics", g.with_(*ads_checks_.KPIS) + """SELECT property_id, key, CASE WHEN availability = 'unavailable' THEN 'not reported for either period' WHEN c IS NOT NULL THEN 'available for the current period only'
  ELSE 'available for the previous period only' END AS reason FROM chg WHERE availability <> 'available'""")
def d04_unavailable_metrics(spark, sf):
    return quality.unavailable_metrics(ads_checks_.kpi_row(spark, sf), ADS_KPIS).select("property_id", "key", "reason")


@register("d08_d13_web_checks", g.with_(*web_checks_.KW, web_checks_.DAILY, web_checks_.CAL, web_checks_.MISS) + """
SELECT property_id, 'equal periods' AS check, 'pass' AS status FROM kj UNION ALL SELECT property_id, 'comparison period has data', CASE WHEN base0 THEN 'warn' ELSE 'pass' END FROM kj
UNION ALL SELECT property_id, 'enough traffic', CASE WHEN sessions_avail <> 'available' THEN 'fail' WHEN sessions_cur < 1000 THEN 'warn' ELSE 'pass' END FROM kj
UNION ALL SELECT property_id, 'key events recorded', CASE WHEN "keyEvents_avail" = 'unavailable' THEN 'fail' WHEN coalesce("keyEvents_cur", 0) = 0 AND coalesce("keyEvents_prev", 0) = 0 THEN 'warn' ELSE 'pass' END FROM kj
UNION ALL SELECT property_id, 'engagement and bounce sum to 100', 'pass' FROM kj WHERE "engagementRate_avail" = 'available' AND abs("engagementRate_cur" + "bounceRate_cur" - 100) < 0.5
UNION ALL SELECT property_id, 'continuous daily collection', CASE WHEN property_id IN (SELECT property_id FROM miss) THEN 'fail' ELSE 'pass' END FROM kj
UNION ALL SELECT property_id, 'ecommerce data', CASE WHEN shop THEN 'pass' ELSE 'info' END FROM kj""")
def d08_web_checks(spark, sf):
    kpis = web.kpis_wide(web.totals(web_checks_.sessions(spark, sf)))
    return quality.web_checks(kpis, web_checks_.missing(spark, sf), EVENT_WINDOWS).select("property_id", "check", "status")


@register("d09_definition_checks", """SELECT c_name AS property_id, 'key event definitions readable' AS check, CASE WHEN c_custkey % 3 = 0 OR n = 0 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT c_name, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) UNION ALL SELECT c_name, 'property schema loaded', CASE WHEN c_custkey % 4 = 0 THEN 'warn' ELSE 'pass' END FROM customer""")
def d09_definition_checks(spark, sf):
    joined = table(spark, sf, "customer").join(orders(spark, sf), F.expr("o_custkey = c_custkey"), "left").groupBy("c_name", "c_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    props = joined.selectExpr("c_name AS property_id", "IF(c_custkey % 3 = 0, NULL, p) AS definitions", "IF(c_custkey % 4 = 0, NULL, true) AS metadata_loaded")
    return quality.definition_checks(props).select("property_id", "check", "status")


@register("d14_d16_d17_d18_search_checks", g.with_(*search_checks_.FIG, g.unpivot("tot", "property_id", search_checks_.SPECS), g.search_chg("kl"), """
fr AS (SELECT property_id, max(date) FILTER (state = 'final') AS lf, max(date) AS la FROM search WHERE date BETWEEN DATE '1999-07-01' AND DATE '1999-07-15' GROUP BY 1)""") + """
SELECT property_id, 'equal periods' AS check, 'pass' AS status FROM tot UNION ALL SELECT property_id, 'finalised data only', CASE WHEN lf IS NULL THEN 'warn' ELSE 'pass' END FROM tot LEFT JOIN fr USING (property_id)
UNION ALL SELECT property_id, 'fresh data excluded', 'pass' FROM fr WHERE la > lf UNION ALL SELECT property_id, 'query coverage of property clicks', 'pass' FROM tot UNION ALL SELECT property_id, 'page coverage of property clicks', 'pass' FROM tot
UNION ALL SELECT property_id, 'sample size', CASE WHEN coalesce(cur_clicks, 0) < 30 THEN 'warn' ELSE 'pass' END FROM tot UNION ALL SELECT DISTINCT property_id, 'zero baseline', 'warn' FROM chg WHERE verdict = 'new'
UNION ALL SELECT DISTINCT property_id, 'partial metrics', 'warn' FROM chg WHERE availability <> 'available' AND verdict <> 'new'
UNION ALL SELECT property_id, 'branded split', 'skipped' FROM tot WHERE property_id IN ('AFRICA', 'ASIA')
UNION ALL SELECT property_id, 'search appearance', 'skipped' FROM tot WHERE property_id <> 'EUROPE'""")
def d14_search_checks(spark, sf):
    rows = search_checks_.web_only(spark, sf)
    t = search_checks_.totals(rows)
    cover = [search.reconciliation(search.records(rows, [d]), t).select("property_id", F.lit(d).alias("dimension"), "coverage_pct") for d in ("query", "page")]
    fresh = periods.freshness(search_checks_.search_stats(spark, sf), F.lit("1999-07-15").cast("date"))
    brands = table(spark, sf, "region").selectExpr("r_name AS property_id").filter("property_id NOT IN ('AFRICA', 'ASIA')")
    return quality.search_checks(search.kpis_wide(t), fresh, cover[0].unionByName(cover[1]), brands, YEAR_WINDOWS,
                                 appearances=table(spark, sf, "region").selectExpr("r_name AS property_id").filter("property_id = 'EUROPE'")).select("property_id", "check", "status")


@register("d15_s8_extract_checks", """SELECT c_name AS property_id, 'queries' AS dataset, CASE WHEN c_custkey % 4 = 0 THEN 'fail' WHEN n >= 10 THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN n >= 10 THEN 'row cap reached' ELSE 'complete' END AS detail FROM (SELECT c_name, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def d15_extract_checks(spark, sf):
    joined = table(spark, sf, "customer").join(orders(spark, sf), F.expr("o_custkey = c_custkey"), "left").groupBy("c_name", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return quality.extract_checks(joined.selectExpr("c_name AS property_id", "'queries' AS dataset", "IF(c_custkey % 4 = 0, NULL, n) AS rows_returned", "n >= 10 AS truncated"))


@register("d20_f9_f10_source_caveats", """SELECT property_id, unnest(list_filter([CASE WHEN n >= 10 THEN 'row cap reached' END, CASE WHEN k % 3 = 0 THEN 'rows folded into (other)' END, CASE WHEN k % 5 = 0 THEN 'rows withheld by thresholding' END,
  CASE WHEN n = 0 THEN 'empty with a reason' END, CASE WHEN k % 7 = 0 THEN 'sampled figures' END], lambda x: x IS NOT NULL)) AS caveat FROM (SELECT c_name AS property_id, c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def d20_source_caveats(spark, sf):
    joined = table(spark, sf, "customer").join(orders(spark, sf), F.expr("o_custkey = c_custkey"), "left").groupBy("c_name", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return quality.source_caveats(joined.selectExpr("c_name AS property_id", "'x' AS dataset", "'current' AS period", "n AS row_count", "10 AS row_limit", "c_custkey % 3 = 0 AS data_loss",
        "c_custkey % 5 = 0 AS thresholding", "IF(n = 0, 'NO_DATA', NULL) AS empty_reason", "c_custkey % 7 = 0 AS sampled")).select("property_id", "caveat")


@register("u3_fw24_distinct_warnings", """SELECT n_name AS property_id, 'data_quality:' || lpad(CAST(row_number() OVER (PARTITION BY n_name ORDER BY s) AS VARCHAR), 2, '0') AS id, 'risk' AS type, t AS evidence
FROM (SELECT n_name, c_mktsegment AS t, min(c_custkey) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def u3_distinct_warnings(spark, sf):
    from tidemark.operators.web_findings import quality_findings
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr("n_name AS property_id", "c_mktsegment AS text", "c_custkey AS seq")
    return quality_findings(quality.distinct_warnings(rows)).select("property_id", "id", "type", F.element_at("evidence", 1).alias("evidence"))


@register("u4_first_reasons", "SELECT property_id, name, seq, reason FROM (SELECT n_name AS property_id, c_mktsegment AS name, c_custkey AS seq, 'r' || c_custkey AS reason, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE rn = 1")
def u4_first_reasons(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr("n_name AS property_id", "c_mktsegment AS name", "c_custkey AS seq", "'r' || c_custkey AS reason")
    return quality.first_reasons(rows)


@register("s9_headline_kpis", g.with_(*ads_checks_.KPIS) + """, h AS (SELECT property_id, key, availability, list_position(['cost', 'conversions', 'cost_per_conversion', 'roas', 'clicks', 'conversion_rate'], key) AS o FROM chg
  WHERE key IN ('cost', 'conversions', 'cost_per_conversion', 'roas', 'clicks', 'conversion_rate')), h2 AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY o) AS n FROM h)
SELECT property_id, key, row_number() OVER (PARTITION BY property_id ORDER BY o) AS position FROM h2 WHERE n <= 3 OR availability <> 'unavailable'""")
def s9_headline_kpis(spark, sf):
    return quality.headline_kpis(long_kpis(ads_checks_.kpi_row(spark, sf), ADS_KPIS, ["property_id"]).drop("position"), HEADLINES["ads"]).select("property_id", "key", "position")


# --- streams --------------------------------------------------------------------------------

def event_stream(spark, sf):
    """The event table as a file stream, shaped like the batch view."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr(
        "CASE user_id % 3 WHEN 0 THEN 'site-a' WHEN 1 THEN 'site-b' ELSE 'site-c' END AS property_id", "user_id", "ts", "event_type AS event_name",
        "event_type IN ('signup', 'purchase') AS is_key", "IF(event_type = 'purchase', CAST(value AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS revenue")


def run_to_table(df, name):
    spark = df.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    query = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


STREAM = """sv AS (SELECT CASE user_id % 3 WHEN 0 THEN 'site-a' WHEN 1 THEN 'site-b' ELSE 'site-c' END AS property_id, user_id, ts, event_id, event_type,
  event_type IN ('signup', 'purchase') AS is_key, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS revenue FROM events)"""


@register("st1_finalised_days", g.with_(STREAM) + """SELECT property_id, event_type AS event_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS event_count, count(*) FILTER (is_key) AS key_events, CAST(sum(revenue) AS DOUBLE) AS revenue
FROM sv WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2, CAST(ts AS DATE)""")
def st1_finalised_days(spark, sf):
    days = run_to_table(streams.finalised_days(event_stream(spark, sf)), "final-days")
    return days.select("property_id", "event_name", F.col("date").cast("string").alias("date"), "event_count", "key_events", F.col("revenue").cast("double").alias("revenue"))


@register("st3_streamed_sessions", g.with_(STREAM, """q0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM sv WINDOW w AS (PARTITION BY property_id, user_id ORDER BY ts, event_id)),
q1 AS (SELECT *, sum(st) OVER (PARTITION BY property_id, user_id ORDER BY ts, event_id) AS no FROM q0)""") + """SELECT property_id, user_id, epoch_us(min(ts)) AS started, count(*) AS events, count(*) FILTER (is_key) AS key_events,
  epoch_us(max(ts)) - epoch_us(min(ts)) > 10000000 OR count(*) FILTER (is_key) > 0 OR count(*) FILTER (event_type = 'view') >= 2 AS engaged
FROM q1 GROUP BY property_id, user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st3_streamed_sessions(spark, sf):
    s = run_to_table(streams.engaged_sessions(event_stream(spark, sf)), "sessions")
    return s.select("property_id", "user_id", F.unix_micros("started").alias("started"), "events", "key_events", "engaged")


@register("st4_event_life", g.with_(EVENT_SQL) + """SELECT property_id, event_name, nullif(count(*) FILTER (date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'), 0)::DOUBLE AS cur, nullif(count(*) FILTER (date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'), 0)::DOUBLE AS prev
FROM web WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1, 2""")
def st4_event_life(spark, sf):
    daily = web_events(spark, sf).groupBy("property_id", "event_name", "date").agg(F.count("*").alias("event_count"), F.count_if("is_key").alias("key_events"))
    return streams.event_life(daily, EVENT_WINDOWS).select("property_id", "event_name", F.col("cur_eventCount").cast("double").alias("cur"), F.col("prev_eventCount").cast("double").alias("prev"))


@register("st4_event_changes", g.with_(EVENT_SQL, """d AS (SELECT property_id, event_name, date, count(*) AS n FROM web
    WHERE (day(date) + length(event_name)) % 11 < 5 AND date < (SELECT CAST(max(ts) AS DATE) FROM events) - 2 GROUP BY ALL)""",
    "m AS (SELECT max(date) AS last FROM d)",
    """i AS (SELECT *, CASE WHEN date <= lag(date) OVER w + 3 THEN 0 ELSE 1 END AS starts, lag(date) OVER w AS previous FROM d
      WINDOW w AS (PARTITION BY property_id, event_name ORDER BY date))""",
    "j AS (SELECT *, sum(starts) OVER (PARTITION BY property_id, event_name ORDER BY date) AS island FROM i)",
    "k AS (SELECT property_id, event_name, island, max(date) AS till, sum(n) AS n FROM j GROUP BY ALL)") + """
SELECT property_id, event_name, 'started' AS change, CAST(date AS VARCHAR) AS date, 0 AS event_count FROM j WHERE starts = 1
UNION ALL SELECT k.property_id, k.event_name, 'stopped', CAST(till + 3 AS VARCHAR), CAST(n AS BIGINT) FROM k, m
WHERE last > till + 5 OR EXISTS (SELECT 1 FROM k x WHERE x.property_id = k.property_id AND x.event_name = k.event_name AND x.island > k.island)""")
def st4_event_changes(spark, sf):
    """Starts and stops from a stream of days; events are thinned out so that they stay away for days."""
    newest = table(spark, sf, "events").agg(F.max("ts").cast("date").alias("m")).first()["m"]
    daily = web_events(spark, sf).filter("(day(date) + length(event_name)) % 11 < 5").filter(F.col("date") < F.date_sub(F.lit(newest), 2)).groupBy(
        "property_id", "event_name", "date").agg(F.count("*").alias("event_count"))
    path = fresh_path(spark, "thin-days")
    # A file for each stretch of days, in their order, as a sink of final days grows.
    for part in range(3):
        daily.filter(f"(day(date) - 1) div 11 = {part}").coalesce(1).write.mode("append").parquet(path)
    days = spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run_to_table(streams.event_changes(days, quiet_days=3), "event-changes").select(
        "property_id", "event_name", "change", F.col("date").cast("string").alias("date"), "event_count")
