"""Registered queries over web-analytics events, each with its DuckDB twin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions.catalog import (
    ECOMMERCE_KPIS, SEGMENT_CSV_METRICS, WEB_FLOORS, WEB_KPIS,
)
from tidemark.functions.compare import long_kpis
from tidemark.operators import day_partials, timeseries, user_bitmaps, web, web_findings, web_history
from tidemark.operators.findings import union_findings
from tidemark.operators.periods import calendar, flag
from tidemark.session import fresh_path, stage

from . import sqlgen as g
from .views import EVENT_SQL, EVENT_WINDOWS, web_events

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def sessions(spark, sf):
    s = web.with_first_seen(web.sessionize(web_events(spark, sf)))
    return flag(s, EVENT_WINDOWS)


def kept_sessions(spark, sf, **options):
    """The same from tables of first days that are kept in three steps, and the events of the windows."""
    path, events = fresh_path(spark, "first-seen"), web_events(spark, sf)
    for through in (date(2024, 1, 4), date(2024, 1, 17), date(2024, 1, 30)):
        web_history.keep(events, path, through)
    return web_history.windowed_sessions(events, EVENT_WINDOWS, path, **options)


def staged(spark, sf):
    """Sessions as a table, for queries that read them more than once."""
    return stage(sessions(spark, sf), "sessions")


def marked_events(spark, sf):
    return flag(web_events(spark, sf), EVENT_WINDOWS).filter("in_current OR in_previous")


WINDOW_COLS = """date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' AS in_current,
    date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' AS in_previous"""
SESS = [EVENT_SQL, """s0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st
  FROM webd WINDOW w AS (PARTITION BY property_id, user_id ORDER BY ts, event_id))""",
        """s1 AS (SELECT *, sum(st) OVER (PARTITION BY property_id, user_id ORDER BY ts, event_id) AS session_no FROM s0)""",
        """s2 AS (SELECT *, row_number() OVER (PARTITION BY property_id, user_id, session_no ORDER BY ts, event_id) AS rn FROM s1)""",
        """s3 AS (SELECT property_id, user_id, session_no, min(ts) AS started, max(ts) AS ended, CAST(min(ts) AS DATE) AS date,
    max(CASE WHEN rn = 1 THEN channel END) AS channel, max(CASE WHEN rn = 1 THEN device END) AS device,
    max(CASE WHEN rn = 1 THEN page END) AS landing_page, max(CASE WHEN rn = 1 THEN country END) AS country,
    count(*) AS events, count(*) FILTER (event_name = 'view') AS views, count(*) FILTER (event_name = 'click') AS clicks,
    count(*) FILTER (event_name = 'signup') AS signups, count(*) FILTER (event_name = 'purchase') AS purchases,
    count(*) FILTER (is_key) AS key_events, sum(revenue) AS revenue, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
  FROM s2 GROUP BY 1, 2, 3)""",
        f"""sess AS (SELECT *, duration_us > 10000000 OR key_events > 0 OR views >= 2 AS engaged,
    min(date) OVER (PARTITION BY property_id, user_id) AS first_seen,
    first_value(channel) OVER (PARTITION BY property_id, user_id ORDER BY session_no) AS first_channel,
    min(CASE WHEN purchases > 0 THEN date END) OVER (PARTITION BY property_id, user_id) AS first_purchase, {WINDOW_COLS} FROM s3)"""]


def breakdown_sql(keys: str, source: str, name: str) -> str:
    cols = []
    for p, f in (("cur_", "in_current"), ("prev_", "in_previous")):
        cols += [
            f"count(*) FILTER ({f}) AS {p}rows", f"count(*) FILTER ({f} AND engaged) AS {p}n_engaged",
            f"count(*) FILTER ({f} AND key_events > 0) AS {p}n_key_sessions",
            f"count(DISTINCT user_id) FILTER ({f}) AS {p}n_users",
            f"count(DISTINCT user_id) FILTER ({f} AND engaged) AS {p}n_active",
            f"count(DISTINCT user_id) FILTER ({f} AND date = first_seen) AS {p}n_new",
            f"count(DISTINCT user_id) FILTER ({f} AND key_events > 0) AS {p}n_key_users",
            f"count(DISTINCT user_id) FILTER ({f} AND purchases > 0) AS {p}n_purchasers",
            f"count(DISTINCT user_id) FILTER ({f} AND date = first_purchase) AS {p}n_first",
        ] + [f"CAST(coalesce(sum({c}) FILTER ({f}), 0) AS DOUBLE) AS {p}s_{c}" for c in web.SESSION_SUMS]
    out = []
    for p in ("cur_", "prev_"):
        def d(a, b, p=p):
            return g.div(p + a, p + b)
        metrics = {
            "activeUsers": f"{p}n_active", "totalUsers": f"{p}n_users", "newUsers": f"{p}n_new", "sessions": f"{p}rows",
            "engagedSessions": f"{p}n_engaged", "engagementRate": d("n_engaged", "rows") + " * 100.0",
            "bounceRate": g.div(f"({p}rows - {p}n_engaged)", p + "rows") + " * 100.0",
            "averageSessionDuration": d("s_duration_us", "rows") + " / 1000000.0", "screenPageViews": f"{p}s_views",
            "screenPageViewsPerSession": d("s_views", "rows"), "sessionsPerUser": d("rows", "n_users"),
            "eventCount": f"{p}s_events", "eventsPerSession": d("s_events", "rows"), "keyEvents": f"{p}s_key_events",
            "sessionKeyEventRate": d("n_key_sessions", "rows") + " * 100.0",
            "userKeyEventRate": d("n_key_users", "n_active") + " * 100.0",
            "totalRevenue": f"{p}s_revenue", "purchaseRevenue": f"{p}s_revenue", "transactions": f"{p}s_purchases",
            "ecommercePurchases": f"{p}s_purchases", "totalPurchasers": f"{p}n_purchasers", "firstTimePurchasers": f"{p}n_first",
            "purchaserRate": d("n_purchasers", "n_active") + " * 100.0", "averagePurchaseRevenue": d("s_revenue", "s_purchases"),
            "averageRevenuePerUser": d("s_revenue", "n_active"), "itemsViewed": f"{p}s_views", "addToCarts": f"{p}s_clicks",
            "itemsAddedToCart": f"{p}s_clicks", "checkouts": f"{p}s_signups", "itemsCheckedOut": f"{p}s_signups",
            "itemsPurchased": f"{p}s_purchases", "cartToViewRate": d("s_clicks", "s_views") + " * 100.0",
            "purchaseToViewRate": d("s_purchases", "s_views") + " * 100.0",
        }
        out += [f"CASE WHEN {p}rows > 0 THEN CAST({sql} AS DOUBLE) END AS {p}{m}" for m, sql in metrics.items()]
    return (f"{name} AS (SELECT {keys}, cur_rows, prev_rows, {', '.join(out)} FROM (SELECT {keys}, {', '.join(cols)} "
            f"FROM {source} GROUP BY {keys}) WHERE cur_rows > 0 OR prev_rows > 0)")


ALL = WEB_KPIS + ECOMMERCE_KPIS
SPECS = [(k.key, k.label, k.unit, k.better, WEB_FLOORS[k.unit]) for k in ALL]
KPIS = SESS + [breakdown_sql("property_id", "sess", "tot"), g.unpivot("tot", "property_id", SPECS), g.std_chg("kl", "chg0"),
               """mix AS (SELECT property_id, bool_or(key = 'sessions' AND direction = 'down') AND
      (bool_or(key = 'keyEvents' AND verdict = 'improved') OR (bool_or(key = 'transactions' AND coalesce(c > 0 OR p > 0, c > 0, p > 0))
        AND bool_or(key = 'totalRevenue' AND verdict = 'improved'))) AS mixed FROM chg0 GROUP BY 1)""",
               """chg AS (SELECT c.* REPLACE (CASE WHEN mixed AND key = 'sessions' THEN 'ambiguous' ELSE verdict END AS verdict)
      FROM chg0 c JOIN mix USING (property_id))"""]


@register("a24_st3_sessions", g.with_(*SESS) + """SELECT property_id, user_id, session_no, CAST(date AS VARCHAR) AS date, channel, device, landing_page,
  country, events, views, purchases, key_events, CAST(revenue AS DOUBLE) AS revenue, duration_us, engaged FROM sess""")
def a24_st3_sessions(spark, sf):
    return web.sessionize(web_events(spark, sf)).select(
        "property_id", "user_id", "session_no", F.col("date").cast("string").alias("date"), "channel", "device", "landing_page",
        "country", "events", "views", "purchases", "key_events", F.col("revenue").cast("double").alias("revenue"),
        "duration_us", "engaged")


@register("c1_c5_web_kpis", g.with_(*KPIS) + """SELECT property_id, position, key, label, unit, c AS current, p AS previous, absolute_change,
  percent_change, availability, direction, verdict, material FROM chg""")
def c1_c5_web_kpis(spark, sf):
    return long_kpis(web.kpis_wide(web.totals(sessions(spark, sf))), ALL, ["property_id"]).select(
        "property_id", "position", "key", "label", "unit", "current", "previous", "absolute_change", "percent_change",
        "availability", "direction", "verdict", "material")


@register("a23_ecommerce_state", g.with_(*SESS, breakdown_sql("property_id", "sess", "tot")) + """
SELECT property_id, CASE WHEN coalesce(cur_transactions > 0, false) OR coalesce(prev_transactions > 0, false) OR coalesce(cur_totalRevenue > 0, false)
  OR coalesce(prev_totalRevenue > 0, false) THEN 'active' WHEN coalesce(cur_transactions, prev_transactions) IS NOT NULL THEN 'no_data' ELSE 'unavailable' END AS ecommerce_state FROM tot""")
def a23_ecommerce_state(spark, sf):
    return web.ecommerce_state(web.totals(sessions(spark, sf))).select("property_id", "ecommerce_state")


@register("a26_new_user_share", g.with_(*SESS, breakdown_sql("property_id", "sess", "tot")) + f"""
SELECT property_id, {g.div('cur_newUsers', 'cur_totalUsers')} * 100.0 AS cur_share, {g.div('prev_newUsers', 'prev_totalUsers')} * 100.0 AS prev_share,
  {g.rnd(g.div('cur_newUsers', 'cur_totalUsers') + ' * 100.0 - ' + g.div('prev_newUsers', 'prev_totalUsers') + ' * 100.0', 4)} AS shift FROM tot""")
def a26_new_user_share(spark, sf):
    return web.new_user_share(web.totals(sessions(spark, sf)))


@register("a26_kept_new_user_share", ORACLE["a26_new_user_share"])
def a26_kept_new_user_share(spark, sf):
    """New users from kept first days: the history of events is not read again."""
    return web.new_user_share(web.totals(kept_sessions(spark, sf, first_channel=False)))


@register("c1_c5_kept_web_kpis", ORACLE["c1_c5_web_kpis"])
def c1_c5_kept_web_kpis(spark, sf):
    return long_kpis(web.kpis_wide(web.totals(kept_sessions(spark, sf, first_channel=False))), ALL, ["property_id"]).select(
        "property_id", "position", "key", "label", "unit", "current", "previous", "absolute_change", "percent_change",
        "availability", "direction", "verdict", "material")


DIMS = {"channels": "channel", "devices": "device", "landing_pages": "landing_page", "geo_country": "country",
        "source_medium": "concat_ws(' / ', channel, device)"}
LONG = "sl AS (" + " UNION ALL ".join(
    f"SELECT *, '{d}' AS dataset, {c} AS key FROM sess" for d, c in DIMS.items()) + ")"
SEGS = SESS + [LONG, breakdown_sql("property_id, dataset, key", "sl", "seg")]
SEG_METRICS = SEGMENT_CSV_METRICS
SEG_OUT = ", ".join(f"{p}{m}" for m in SEG_METRICS for p in ("cur_", "prev_"))
CAPPED = """capd AS (SELECT *, count(*) OVER (PARTITION BY property_id, dataset) >= cap AS hit_cap FROM (
  SELECT *, row_number() OVER (PARTITION BY property_id, dataset ORDER BY cur_sessions DESC NULLS LAST, key) AS rank,
    CASE dataset WHEN 'channels' THEN 50 WHEN 'devices' THEN 10 WHEN 'landing_pages' THEN 100 WHEN 'geo_country' THEN 30 ELSE 50 END AS cap FROM seg))"""


def segments(spark, sf, dims=None):
    return web.all_breakdowns(sessions(spark, sf), dims or DIMS)


def one_dataset(spark, sf, dataset):
    return segments(spark, sf, {dataset: DIMS[dataset]})


@register("a11_p17_breakdowns", g.with_(*SEGS) + f"SELECT property_id, dataset, key, {SEG_OUT} FROM seg")
def a11_p17_breakdowns(spark, sf):
    s = segments(spark, sf)
    return s.select("property_id", "dataset", "key", *[
        F.col(f"{p}{m}").cast("double").alias(f"{p}{m}") for m in SEG_METRICS for p in ("cur_", "prev_")])


@register("s3_s5_capped_segments", g.with_(*SEGS, CAPPED) + "SELECT property_id, dataset, key, cur_sessions, rank, hit_cap FROM capd")
def s3_s5_capped_segments(spark, sf):
    return web.ranked(segments(spark, sf)).select(
        "property_id", "dataset", "key", F.col("cur_sessions").cast("double").alias("cur_sessions"), "rank", "hit_cap")


# Columns the stand-in events lack; a session has them from its first event.
MORE = {"hostname": "concat('www.', channel, '.example')", "browser": "concat('b', CAST(user_id % 3 AS STRING))", "os": "concat('os', CAST(user_id % 2 AS STRING))",
        "platform": "concat(device, '-web')", "region": "concat(country, '-', device)", "city": "concat(country, '/', page)",
        "campaign": "concat(channel, '-', CAST(user_id % 4 AS STRING))"}
MORE_SQL = {k: v.replace("page", "landing_page").replace("AS STRING", "AS VARCHAR") for k, v in MORE.items()} | {
    "revenue_by_channel": "channel", "revenue_by_device": "device"}
MORE_LONG = "ml AS (" + " UNION ALL ".join(f"SELECT *, '{d}' AS dataset, {c} AS key FROM sess" for d, c in MORE_SQL.items()) + ")"


@register("a11_more_breakdowns", g.with_(*SESS, MORE_LONG, breakdown_sql("property_id, dataset, key", "ml", "seg")) + f"SELECT property_id, dataset, key, {SEG_OUT} FROM seg")
def a11_more_breakdowns(spark, sf):
    """Host, browser, system, platform, region, city, campaign, and revenue by channel and device."""
    events = web_events(spark, sf).withColumns({k: F.expr(v) for k, v in MORE.items()})
    sess = flag(web.with_first_seen(web.sessionize(events, dimensions=tuple(MORE))), EVENT_WINDOWS)
    s = web.all_breakdowns(sess, {k: k for k in MORE} | {"revenue_by_channel": "channel", "revenue_by_device": "device"})
    return s.select("property_id", "dataset", "key", *[
        F.col(f"{p}{m}").cast("double").alias(f"{p}{m}") for m in SEG_METRICS for p in ("cur_", "prev_")])


@register("a11_first_user_channels", g.with_(*SESS, breakdown_sql("property_id, first_channel", "sess", "fu")) + """
SELECT property_id, first_channel AS key, "cur_totalUsers", "cur_newUsers", "cur_engagementRate", row_number() OVER (PARTITION BY property_id
  ORDER BY "cur_totalUsers" DESC NULLS LAST, first_channel) AS rank FROM fu""")
def a11_first_user_channels(spark, sf):
    c = web.ranked(segments(spark, sf, {"first_user_channels": "first_channel"}))
    return c.select("property_id", "key", *[F.col(f"cur_{m}").cast("double").alias(f"cur_{m}") for m in ("totalUsers", "newUsers", "engagementRate")], "rank")


@register("a11_kept_first_user_channels", ORACLE["a11_first_user_channels"])
def a11_kept_first_user_channels(spark, sf):
    c = web.ranked(web.all_breakdowns(kept_sessions(spark, sf), {"first_user_channels": "first_channel"}))
    return c.select("property_id", "key", *[F.col(f"cur_{m}").cast("double").alias(f"cur_{m}") for m in ("totalUsers", "newUsers", "engagementRate")], "rank")


THREE = {"all": (date(2024, 1, 1), date(2024, 1, 30)), "first days": (date(2024, 1, 1), date(2024, 1, 7)), "middle": (date(2024, 1, 12), date(2024, 1, 19))}
BITMAP_SQL = SESS + ["bl AS (" + " UNION ALL ".join(f"SELECT *, '{d}' AS dataset, {c} AS key FROM sess" for d, c in {
    "channels": "channel", "devices": "device", "all": "'all'"}.items()) + ")",
    "bw AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, (a, b) in THREE.items()) + ") w(win, s, e))"]


@register("a11_user_bitmaps", g.with_(*BITMAP_SQL) + """
SELECT property_id, dataset, key, win AS window, count(DISTINCT user_id) AS totalUsers, count(DISTINCT user_id) FILTER (engaged) AS activeUsers,
  count(DISTINCT user_id) FILTER (date = first_seen) AS newUsers, count(DISTINCT user_id) FILTER (key_events > 0) AS keyUsers,
  count(DISTINCT user_id) FILTER (purchases > 0) AS totalPurchasers, count(DISTINCT user_id) FILTER (date = first_purchase) AS firstTimePurchasers
FROM bl JOIN bw ON date BETWEEN s AND e GROUP BY ALL""")
def a11_user_bitmaps(spark, sf):
    """Users of three windows from one table of bitmaps per day and segment."""
    seen = staged(spark, sf)
    numbers = stage(user_bitmaps.user_numbers(seen), "user-numbers")
    pieces = stage(user_bitmaps.day_bitmaps(seen, numbers, {"channels": "channel", "devices": "device", "all": "'all'"}), "user-bitmaps")
    return user_bitmaps.distinct_users(pieces, THREE)


@register("a06_kept_day_sums", g.with_(EVENT_SQL, f"we AS (SELECT *, {WINDOW_COLS} FROM webd)") + """
SELECT property_id, event_name, count(*) FILTER (in_current) AS cur_rows, count(*) FILTER (in_previous) AS prev_rows,
  CAST(sum(revenue) FILTER (in_current) AS DOUBLE) AS cur_revenue, CAST(sum(revenue) FILTER (in_previous) AS DOUBLE) AS prev_revenue,
  sum(CAST(is_key AS INT)) FILTER (in_current) AS cur_key_events, sum(CAST(is_key AS INT)) FILTER (in_previous) AS prev_key_events
FROM we WHERE in_current OR in_previous GROUP BY 1, 2""")
def a06_kept_day_sums(spark, sf):
    """A comparison from day sums that three refreshes have kept; each reads what was not final before."""
    path, keys = fresh_path(spark, "day-sums"), ["property_id", "event_name"]
    measures = {"revenue": F.col("revenue"), "key_events": F.col("is_key").cast("int")}
    for arrived, final in ((date(2024, 1, 12), date(2024, 1, 9)), (date(2024, 1, 20), date(2024, 1, 20)), (date(2024, 1, 30), date(2024, 1, 27))):
        day_partials.refresh(web_events(spark, sf).filter(F.col("date") <= F.lit(arrived)), path, keys, measures, final)
    out = day_partials.compared(day_partials.read(spark, path), EVENT_WINDOWS, keys, [*measures])
    return out.select(*keys, "cur_rows", "prev_rows", *(F.col(f"{p}revenue").cast("double").alias(f"{p}revenue") for p in ("cur_", "prev_")), "cur_key_events", "prev_key_events")


@register("a11_p17_pages", g.with_(EVENT_SQL, f"we AS (SELECT *, {WINDOW_COLS} FROM webd)", """pg AS (SELECT property_id, page || ' / ' || country AS key,
    nullif(count(*) FILTER (in_current), 0) AS n, count(*) FILTER (in_current AND event_name = 'view') AS v, count(DISTINCT user_id) FILTER (in_current) AS u,
    CAST(coalesce(sum(revenue) FILTER (in_current), 0) AS DOUBLE) AS r, nullif(count(*) FILTER (in_previous), 0) AS pn, count(*) FILTER (in_previous AND event_name = 'view') AS pv
  FROM we WHERE in_current OR in_previous GROUP BY 1, 2)""") + """
SELECT property_id, key, CASE WHEN n > 0 THEN v END::DOUBLE AS "cur_screenPageViews", CASE WHEN pn > 0 THEN pv END::DOUBLE AS "prev_screenPageViews",
  CASE WHEN n > 0 THEN u END::DOUBLE AS "cur_totalUsers", CASE WHEN n > 0 THEN r END AS "cur_itemRevenue",
  row_number() OVER (PARTITION BY property_id ORDER BY CASE WHEN n > 0 THEN v END DESC NULLS LAST, key) AS rank FROM pg""")
def a11_p17_pages(spark, sf):
    p = web.ranked(web.event_breakdown(marked_events(spark, sf), {"path": "page", "title": "country"}, "pages"))
    return p.select("property_id", "key", *[F.col(c).cast("double").alias(c) for c in (
        "cur_screenPageViews", "prev_screenPageViews", "cur_totalUsers", "cur_itemRevenue")], "rank")


def seg_change(source, name="schg"):
    return g.std_chg(f"(SELECT *, cur_sessions AS c, prev_sessions AS p, 50.0::DOUBLE AS floor, 'higher' AS better FROM {source})", name)


def movers_sql(dataset, k, extra="", name="mov"):
    return [seg_change(f"(SELECT * FROM capd WHERE dataset = '{dataset}' {extra})"),
            f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY abs(coalesce(absolute_change, 0)) DESC, key) AS mrank
      FROM schg WHERE material OR verdict = 'new' QUALIFY mrank <= {k})"""]


@register("an26_segment_movers", g.with_(*SEGS, CAPPED, *movers_sql("channels", 5)) +
          "SELECT property_id, key, absolute_change, percent_change, direction, verdict, mrank AS rank FROM mov")
def an26_segment_movers(spark, sf):
    return web.movers(one_dataset(spark, sf, "channels"), 5).select(
        "property_id", "key", F.col("d_sessions.absolute_change").alias("absolute_change"),
        F.col("d_sessions.percent_change").alias("percent_change"), F.col("d_sessions.direction").alias("direction"),
        F.col("d_sessions.verdict").alias("verdict"), "rank")


JUDGED = """jud AS (SELECT *, median(cur_engagementRate) OVER (PARTITION BY property_id) AS med, row_number() OVER (PARTITION BY property_id ORDER BY rank) AS jr
  FROM capd WHERE dataset = 'landing_pages' AND cur_sessions >= 100)"""


@register("a21_an23_judged_landing_pages", g.with_(*SEGS, CAPPED, JUDGED) + f"""
SELECT property_id, key, cur_sessions, cur_engagementRate, {g.rnd('med', 6)} AS median_engagement, CASE WHEN jr <= 15 THEN jr END AS judged_rank FROM jud""")
def a21_an23_judged_landing_pages(spark, sf):
    j = web.judged_landing_pages(one_dataset(spark, sf, "landing_pages"))
    from tidemark.functions.nulls import rnd
    return j.select("property_id", "key", F.col("cur_sessions").cast("double").alias("cur_sessions"), "cur_engagementRate",
                    rnd(F.col("median_engagement"), 6).alias("median_engagement"), "judged_rank")


GAP = """gap0 AS (SELECT property_id, max(CASE WHEN key = 'desktop' THEN cur_sessionKeyEventRate END) AS desktop_rate,
    max(CASE WHEN key = 'mobile' THEN cur_sessionKeyEventRate END) AS mobile_rate, max(CASE WHEN key = 'desktop' THEN cur_sessions END) AS ds,
    max(CASE WHEN key = 'mobile' THEN cur_sessions END) AS ms FROM seg WHERE dataset = 'devices' GROUP BY 1),
gap1 AS (SELECT *, desktop_rate - mobile_rate AS gap, abs(desktop_rate - mobile_rate) / nullif(greatest(desktop_rate, mobile_rate), 0) * 100.0 AS relative
  FROM gap0 WHERE desktop_rate IS NOT NULL AND mobile_rate IS NOT NULL)"""


@register("an24_device_gap", g.with_(*SEGS, GAP) + "SELECT property_id, desktop_rate, mobile_rate, gap, relative FROM gap1 WHERE ds >= 10 AND ms >= 10 AND abs(gap) >= 1 AND relative >= 25")
def an24_device_gap(spark, sf):
    return web.device_gap(segments(spark, sf, {"devices": "device"}), 10).select(
        "property_id", "desktop_rate", "mobile_rate", "gap", "relative")


EVT = [EVENT_SQL, f"we AS (SELECT *, {WINDOW_COLS} FROM webd)",
       """defs AS (SELECT DISTINCT property_id, event_name, event_name = 'signup' AS declared FROM web WHERE event_name IN ('signup', 'click'))""",
       """ev AS (SELECT property_id, event_name, nullif(count(*) FILTER (in_current), 0)::DOUBLE AS c, nullif(count(*) FILTER (in_previous), 0)::DOUBLE AS p,
      count(*) FILTER (in_current AND is_key) AS cur_key, count(DISTINCT user_id) FILTER (in_current) AS cur_users, 50.0::DOUBLE AS floor, 'context' AS better
      FROM we WHERE in_current OR in_previous GROUP BY 1, 2)""", g.std_chg("ev", "ec"),
       """evt AS (SELECT ec.*, defs.event_name IS NOT NULL OR cur_key > 0 AS is_key_event, coalesce(declared, false) AS declared_primary
      FROM ec LEFT JOIN defs USING (property_id, event_name))"""]


def definitions(spark, sf):
    named = web_events(spark, sf).filter("event_name IN ('signup', 'click')")
    return named.select("property_id", "event_name").distinct().withColumn("declared", F.col("event_name") == "signup")


def events_table(spark, sf):
    return web.event_table(marked_events(spark, sf), definitions(spark, sf))


@register("an22_j6_event_table", g.with_(*EVT) + """SELECT property_id, event_name, c AS current, p AS previous, percent_change, availability, verdict, material,
  cur_users, is_key_event, declared_primary FROM evt""")
def an22_j6_event_table(spark, sf):
    return events_table(spark, sf).select(
        "property_id", "event_name", *[F.col(f"d_count.{c}").alias(c) for c in (
            "current", "previous", "percent_change", "availability", "verdict", "material")],
        F.col("cur_totalUsers").alias("cur_users"), "is_key_event", "declared_primary")


DAILY = """wd AS (SELECT property_id, CASE WHEN in_current THEN 'current' ELSE 'previous' END AS period, date, count(*) AS sessions,
    count(*) FILTER (engaged) AS engagedSessions, sum(key_events)::DOUBLE AS keyEvents, CAST(sum(revenue) AS DOUBLE) AS totalRevenue
  FROM sess WHERE in_current OR in_previous GROUP BY 1, 2, 3)"""


def daily(spark, sf):
    return web.daily(sessions(spark, sf))


def days(spark, sf):
    return calendar(EVENT_WINDOWS, web_events(spark, sf).select("property_id").distinct())


CAL = """cal AS (SELECT property_id, period, CAST(d AS DATE) AS date, date_diff('day', s, CAST(d AS DATE)) AS day_number FROM
  (SELECT DISTINCT property_id FROM web), (VALUES ('current', DATE '2024-01-16', DATE '2024-01-30'), ('previous', DATE '2024-01-01', DATE '2024-01-15')) w(period, s, e),
  LATERAL (SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d))"""


@register("w7_daily_calendar", g.with_(*SESS, DAILY, CAL) + """SELECT property_id, period, CAST(date AS VARCHAR) AS date, day_number,
  sessions::DOUBLE AS sessions, keyEvents, totalRevenue, sessions IS NOT NULL AS returned FROM cal LEFT JOIN wd USING (property_id, period, date)""")
def w7_daily_calendar(spark, sf):
    return timeseries.on_calendar(days(spark, sf), daily(spark, sf)).select(
        "property_id", "period", F.col("date").cast("string").alias("date"), "day_number",
        *[F.col(c).cast("double").alias(c) for c in ("sessions", "keyEvents", "totalRevenue")], "returned")


@register("w8_aligned_days", g.with_(*SESS, DAILY, CAL) + """SELECT property_id, day_number, CAST(max(CASE WHEN period = 'current' THEN date END) AS VARCHAR) AS date,
  max(CASE WHEN period = 'current' THEN sessions END)::DOUBLE AS current, max(CASE WHEN period = 'previous' THEN sessions END)::DOUBLE AS previous
FROM cal LEFT JOIN wd USING (property_id, period, date) GROUP BY 1, 2""")
def w8_aligned_days(spark, sf):
    a = timeseries.aligned(daily(spark, sf), days(spark, sf), "sessions")
    return a.select("property_id", "day_number", F.col("date").cast("string").alias("date"),
                    F.col("current").cast("double").alias("current"), F.col("previous").cast("double").alias("previous"))


MISS = "miss AS (SELECT property_id, date FROM cal WHERE period = 'current' AND (property_id, date) NOT IN (SELECT property_id, date FROM wd))"


@register("an3_missing_days", g.with_(*SESS, DAILY, CAL, MISS) + "SELECT property_id, CAST(date AS VARCHAR) AS date FROM miss")
def an3_missing_days(spark, sf):
    return missing(spark, sf).withColumn("date", F.col("date").cast("string"))


def missing(spark, sf):
    return timeseries.missing_days(days(spark, sf), daily(spark, sf).filter("period = 'current'"))


ZS = f"""zs AS (SELECT property_id, CAST(date AS VARCHAR) AS date, metric, value, median, {g.rnd('rz', 2)} AS z, CASE WHEN rz > 0 THEN 'spike' ELSE 'drop' END AS direction
  FROM (SELECT *, 0.6745::DOUBLE * (value - median) / mad AS rz FROM (SELECT *, median(abs(value - median)) OVER (PARTITION BY property_id, metric) AS mad FROM (
    SELECT *, median(value) OVER (PARTITION BY property_id, metric) AS median, count(*) OVER (PARTITION BY property_id, metric) AS n FROM (
      SELECT property_id, date, 'sessions' AS metric, sessions::DOUBLE AS value FROM wd WHERE period = 'current'
      UNION ALL SELECT property_id, date, 'keyEvents', keyEvents FROM wd WHERE period = 'current'
      UNION ALL SELECT property_id, date, 'totalRevenue', totalRevenue FROM wd WHERE period = 'current'))) WHERE n >= 10 AND mad <> 0)
  WHERE abs(rz) >= 3.5)"""


def anomalies(spark, sf):
    cur = daily(spark, sf).filter("period = 'current'")
    return timeseries.web_anomalies(cur, ["sessions", "keyEvents", "totalRevenue"])


@register("an1_a19_web_anomalies", g.with_(*SESS, DAILY, ZS) + "SELECT property_id, date, metric, value, z, direction FROM zs")
def an1_a19_web_anomalies(spark, sf):
    return anomalies(spark, sf).drop("median").withColumn("date", F.col("date").cast("string"))


DRIFT = f"""drf AS (SELECT property_id, second / first - 1 AS drift FROM (SELECT property_id, {g.div('sum(sessions) FILTER (rn <= n // 2)', 'count(*) FILTER (rn <= n // 2)')} AS first,
    {g.div('sum(sessions) FILTER (rn > n // 2)', 'count(*) FILTER (rn > n // 2)')} AS second
  FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY property_id) AS n FROM wd WHERE period = 'current')
  WHERE n >= 14 GROUP BY 1) WHERE first <> 0)"""


@register("an4_win6_drift", g.with_(*SESS, DAILY, DRIFT) + "SELECT property_id, drift FROM drf")
def an4_win6_drift(spark, sf):
    return timeseries.drift(daily(spark, sf).filter("period = 'current'"))


@register("p15_p33_sparklines", g.with_(*SESS, DAILY, f"""ser AS (SELECT property_id, 'sessions' AS metric, date, sessions::DOUBLE AS value FROM wd WHERE period = 'current'
  UNION ALL SELECT property_id, 'engagementRate', date, {g.div('engagedSessions', 'sessions')} * 100.0 FROM wd WHERE period = 'current'
  UNION ALL SELECT property_id, 'sessionKeyEventRate', date, {g.div('keyEvents', 'sessions')} * 100.0 FROM wd WHERE period = 'current')""") + f"""
SELECT property_id, metric, CAST(date AS VARCHAR) AS date, 1.0::DOUBLE + i * ((158.0::DOUBLE - 2.0::DOUBLE) / (n - 1)) AS x,
  CASE WHEN hi = lo THEN 13.0::DOUBLE ELSE 3.0::DOUBLE + 20.0::DOUBLE - ((value - lo) / (hi - lo)) * 20.0::DOUBLE END AS y
FROM (SELECT *, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi, row_number() OVER (PARTITION BY property_id, metric ORDER BY date) - 1 AS i
  FROM ser WHERE value IS NOT NULL WINDOW w AS (PARTITION BY property_id, metric)) WHERE n >= 3""")
def p15_p33_sparklines(spark, sf):
    series = timeseries.daily_series(daily(spark, sf).filter("period = 'current'"), ["sessions", "engagementRate", "sessionKeyEventRate"])
    return timeseries.sparkline(series).withColumn("date", F.col("date").cast("string"))


FUNNEL = """fun0 AS (SELECT property_id, key, c, p, CASE key WHEN 'itemsViewed' THEN 1 WHEN 'itemsAddedToCart' THEN 2 WHEN 'itemsCheckedOut' THEN 3 ELSE 4 END AS step
  FROM chg WHERE key IN ('itemsViewed', 'itemsAddedToCart', 'itemsCheckedOut', 'itemsPurchased') AND availability = 'available'
    AND property_id IN (SELECT property_id FROM chg WHERE key = 'transactions' AND (c > 0 OR p > 0))),
fun AS (SELECT property_id, step, key, c AS current, p AS previous, c / nullif(lag(c) OVER w, 0) * 100.0 AS step_rate_current,
  p / nullif(lag(p) OVER w, 0) * 100.0 AS step_rate_previous FROM fun0 WINDOW w AS (PARTITION BY property_id ORDER BY step))"""


@register("an25_win5_funnel", g.with_(*KPIS, FUNNEL) + "SELECT * FROM fun")
def an25_win5_funnel(spark, sf):
    return web.funnel(web.kpis_wide(web.totals(sessions(spark, sf)))).drop("label")


@register("an27_geo_movers", g.with_(*SEGS, CAPPED, """geo AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY rank) AS n FROM capd
  WHERE dataset = 'geo_country' AND rank <= 8 AND cur_sessions >= 20)""", seg_change("(SELECT * FROM geo WHERE n BETWEEN 2 AND 4)")) +
  "SELECT property_id, key, absolute_change FROM schg WHERE material AND abs(absolute_change) >= 20")
def an27_geo_movers(spark, sf):
    return web.geo_movers(one_dataset(spark, sf, "geo_country"), 20).select(
        "property_id", "key", F.col("d_sessions.absolute_change").alias("absolute_change"))


UNATT = """una AS (SELECT property_id, dataset, key, share, CASE WHEN share >= 20 THEN 'fail' ELSE 'warn' END AS status FROM (
  SELECT *, coalesce(cur_sessions, 0)::DOUBLE / nullif(sum(coalesce(cur_sessions, 0)) OVER (PARTITION BY property_id, dataset), 0)::DOUBLE * 100.0 AS share
  FROM seg WHERE dataset IN ('channels', 'landing_pages', 'source_medium')) WHERE lower(trim(key)) IN ('(not set)', '(other)', '(not provided)', '') AND share >= 5)"""


@register("d10_f3_unattributed", g.with_(*SEGS, UNATT) + "SELECT * FROM una")
def d10_f3_unattributed(spark, sf):
    return web.unattributed(segments(spark, sf), ["channels", "landing_pages", "source_medium"])


@register("d11_direct_surge", g.with_(*SEGS) + """SELECT property_id, cur_sessions, prev_sessions FROM seg WHERE dataset = 'channels' AND lower(key) = 'direct'
  AND prev_sessions > 0 AND (cur_sessions - prev_sessions) / prev_sessions >= 0.30 AND cur_sessions - prev_sessions >= 100""")
def d11_direct_surge(spark, sf):
    return web.direct_surge(segments(spark, sf, {"channels": "channel"})).select(
        "property_id", *[F.col(c).cast("double").alias(c) for c in ("cur_sessions", "prev_sessions")])


# --- findings -------------------------------------------------------------------------------

OUT = ["property_id", "id", "type", "severity", "confidence", "scope", "entity"]
KW = KPIS + [g.pivot("chg", "property_id", [k.key for k in ALL]),
             """kj AS (SELECT *, coalesce(sessions_prev, 0) = 0 AS base0, coalesce(transactions_cur > 0, false) OR coalesce(transactions_prev > 0, false) AS shop FROM kw)"""]
_H = "{0}_avail = 'available'"
_BOTH = "NOT base0 AND sessions_avail = 'available' AND keyEvents_avail = 'available'"
_SHOP = "NOT base0 AND shop AND totalRevenue_avail = 'available' AND sessions_avail = 'available'"
_LOST = "totalRevenue_verdict = 'declined' AND sessions_verdict IN ('flat', 'improved')"
_NS = "(newUsers_cur / nullif(totalUsers_cur, 0) * 100.0 - newUsers_prev / nullif(totalUsers_prev, 0) * 100.0)"
_GAPE = "(eventCount_pct - sessions_pct)"


def _r(cond, i, t, s="'medium'", c="'high'", sc="'property'"):
    return (cond, f"'{i}'", t, s, c, sc, "NULL")


KPI_RULES = [
    _r("base0", "no_baseline", "'observation'"),
    _r(f"{_BOTH} AND sessions_dir = 'up' AND keyEvents_verdict = 'declined' AND (sessions_material OR keyEvents_material)", "traffic_up_key_events_down", "'weakness'", "'high'"),
    _r(f"{_BOTH} AND sessions_dir = 'down' AND keyEvents_verdict = 'improved'", "traffic_down_key_events_up", "'strength'"),
    _r(f"{_BOTH} AND sessions_verdict = 'improved' AND keyEvents_verdict = 'improved'", "traffic_and_key_events_up", "'strength'", "'low'"),
    _r(f"{_BOTH} AND sessions_verdict = 'declined' AND keyEvents_verdict = 'declined'", "traffic_and_key_events_down", "'weakness'", "'high'"),
    _r("NOT base0 AND engagementRate_avail = 'available' AND engagementRate_material AND engagementRate_verdict IN ('improved', 'declined')", "engagement_rate_move",
       "CASE WHEN engagementRate_verdict = 'improved' THEN 'strength' ELSE 'weakness' END", "CASE WHEN abs(engagementRate_abs) < 5 THEN 'medium' ELSE 'high' END"),
    _r("NOT base0 AND sessionKeyEventRate_avail = 'available' AND sessionKeyEventRate_material AND sessionKeyEventRate_verdict = 'declined'", "key_event_rate_decline", "'weakness'", "'high'"),
    _r(f"NOT base0 AND abs({_GAPE}) >= 40 AND abs(eventCount_pct) >= 25", "event_volume_vs_traffic", "'anomaly'", "'medium'", "'medium'", "'tracking'"),
    _r(f"NOT base0 AND abs({_NS}) >= 8", "new_user_mix_shift", "'observation'", "'low'"),
    _r(f"{_SHOP} AND {_LOST}", "revenue_down_traffic_stable", "'weakness'", "'high'", "'high'", "'ecommerce'"),
    _r(f"{_SHOP} AND NOT ({_LOST}) AND totalRevenue_verdict = 'improved' AND totalRevenue_material", "revenue_up", "'strength'", "'medium'", "'high'", "'ecommerce'"),
]
_THIN = "(NOT base0 AND ((sessions_avail = 'available' AND sessions_cur < 1000) OR (keyEvents_avail = 'available' AND least(keyEvents_cur, keyEvents_prev) < 15)))"
KPI_F = f"""kpi_f AS (SELECT property_id, id, type, CASE WHEN {_THIN} THEN 'low' ELSE severity END AS severity,
    CASE WHEN {_THIN} THEN 'low' ELSE confidence END AS confidence, scope, entity
  FROM ({g.findings('kj', KPI_RULES, 'property_id, base0, sessions_avail, sessions_cur, keyEvents_avail, keyEvents_cur, keyEvents_prev')}))"""


@register("fw01_fw10_kpi_findings", g.with_(*KW, KPI_F) + "SELECT * FROM kpi_f")
def fw01_fw10_kpi_findings(spark, sf):
    return web_findings.kpi_findings(web.kpis_wide(web.totals(sessions(spark, sf)))).select(*OUT)


_SMALL = "coalesce(cur_sessions, 0) < 100 AND coalesce(prev_sessions, 0) < 100"
BASES = """bs AS (SELECT property_id, cur_sessions AS total_sessions, coalesce(prev_sessions, 0) = 0 AS base0 FROM tot)"""
ACQ = f"""acq AS (SELECT property_id, 'acquisition_move:' || key AS id, CASE WHEN direction = 'up' THEN 'strength' ELSE 'weakness' END AS type,
    CASE WHEN {_SMALL} THEN 'low' WHEN coalesce(cur_sessions / nullif(total_sessions, 0) * 100.0, 0) > 15 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN {_SMALL} THEN 'low' ELSE 'high' END AS confidence, 'acquisition' AS scope, key AS entity, direction
  FROM mov JOIN bs USING (property_id) WHERE NOT base0)"""


@register("fw11_acquisition_findings", g.with_(*SEGS, CAPPED, *movers_sql("channels", 5), breakdown_sql("property_id", "sess", "tot"), BASES, ACQ) +
          "SELECT * EXCLUDE (direction) FROM acq")
def fw11_acquisition_findings(spark, sf):
    s = staged(spark, sf)
    kpis = web.kpis_wide(web.totals(s))
    top = web.movers(web.all_breakdowns(s, {"channels": "channel"}), 5)
    return web_findings.segment_findings(web.with_property_sessions(top, kpis)).select(*OUT)


LAND = [JUDGED.replace(">= 100", ">= 10"),
        *movers_sql("landing_pages", 6, "AND (coalesce(cur_sessions, 0) >= 10 OR coalesce(prev_sessions, 0) >= 10)"),
        """land AS (SELECT property_id, 'landing_weak_engagement:' || key AS id, 'weakness' AS type, 'medium' AS severity, 'high' AS confidence, 'content' AS scope, key AS entity
      FROM jud WHERE jr <= 15 AND cur_sessions >= 20 AND cur_engagementRate < med - 15
    UNION ALL SELECT property_id, 'landing_no_key_events:' || key, 'weakness', 'medium', 'medium', 'content', key FROM jud WHERE jr <= 15 AND cur_sessions >= 20 AND cur_keyEvents = 0
    UNION ALL SELECT property_id, 'landing_move:' || key, CASE WHEN direction = 'up' THEN 'strength' ELSE 'weakness' END, 'medium', 'high', 'content', key
      FROM mov JOIN bs USING (property_id) WHERE NOT base0 AND property_id IN (SELECT property_id FROM jud)
    UNION ALL SELECT property_id, 'landing_pages_below_floor', 'observation', 'low', 'high', 'content', NULL FROM capd WHERE dataset = 'landing_pages'
      GROUP BY property_id HAVING coalesce(max(cur_sessions), 0) < 10)"""]


@register("fw12_fw14_landing_findings", g.with_(*SEGS, CAPPED, breakdown_sql("property_id", "sess", "tot"), BASES, *LAND) + "SELECT * FROM land")
def fw12_fw14_landing_findings(spark, sf):
    s = staged(spark, sf)
    kpis = web.kpis_wide(web.totals(s))
    pages = web.all_breakdowns(s, {"landing_pages": "landing_page"})
    moved = web.movers(pages.filter("coalesce(cur_sessions, 0) >= 10 OR coalesce(prev_sessions, 0) >= 10"), 6)
    return web_findings.landing_findings(
        web.judged_landing_pages(pages, 10), web.with_property_sessions(moved, kpis), pages, 10).select(*OUT)


@register("fw15_device_findings", g.with_(*SEGS, GAP) + """SELECT property_id, 'device_key_event_gap' AS id, 'weakness' AS type,
  CASE WHEN relative >= 50 THEN 'high' ELSE 'medium' END AS severity, 'high' AS confidence, 'device' AS scope, NULL AS entity
FROM gap1 WHERE ds >= 10 AND ms >= 10 AND abs(gap) >= 1 AND relative >= 25""")
def fw15_device_findings(spark, sf):
    return web_findings.device_findings(web.device_gap(segments(spark, sf, {"devices": "device"}), 10)).select(*OUT)


EVF = """evf AS (SELECT e.*, base0, coalesce(p >= 25 AND coalesce(c, 0) = 0, false) AS stopped, coalesce(coalesce(p, 0) = 0 AND c >= 50, false) AS fresh,
    coalesce(abs(percent_change) >= 60 AND p >= 100 AND availability = 'available', false) AS swing FROM evt e JOIN bs USING (property_id)),
ev_f AS (SELECT property_id, 'event_stopped:' || event_name AS id, 'anomaly' AS type, CASE WHEN is_key_event THEN 'high' ELSE 'medium' END AS severity,
    'medium' AS confidence, 'tracking' AS scope, event_name AS entity FROM evf WHERE NOT base0 AND stopped
  UNION ALL SELECT property_id, 'event_new:' || event_name, 'observation', 'low', 'medium', 'tracking', event_name FROM evf WHERE NOT base0 AND NOT stopped AND fresh
  UNION ALL SELECT property_id, 'event_swing:' || event_name, CASE WHEN abs(percent_change) >= 150 THEN 'anomaly' ELSE 'observation' END,
    CASE WHEN is_key_event THEN 'high' ELSE 'low' END, 'medium', CASE WHEN is_key_event THEN 'events' ELSE 'tracking' END, event_name
    FROM evf WHERE NOT base0 AND NOT stopped AND NOT fresh AND swing)"""


@register("fw16_st4_event_findings", g.with_(*SESS, breakdown_sql("property_id", "sess", "tot"), BASES, *EVT[1:], EVF) + "SELECT * FROM ev_f")
def fw16_st4_event_findings(spark, sf):
    bases = web.kpis_wide(web.totals(sessions(spark, sf))).select("property_id", "baseline_empty")
    return web_findings.event_findings(events_table(spark, sf), bases).select(*OUT)


@register("fw17_silent_key_events", g.with_(*EVT) + """SELECT property_id, 'key_events_defined_but_silent' AS id, 'risk' AS type, 'high' AS severity, 'high' AS confidence,
  'tracking' AS scope, NULL AS entity FROM (SELECT DISTINCT property_id FROM webd) WHERE property_id NOT IN (SELECT property_id FROM ev WHERE event_name = 'refund')""")
def fw17_silent_key_events(spark, sf):
    rows = web_events(spark, sf).select("property_id").distinct()
    defs = rows.withColumn("event_name", F.lit("refund")).withColumn("declared", F.lit(True))
    table = web.event_table(marked_events(spark, sf).withColumn("is_key", F.lit(False)), defs)
    return web_findings.silent_key_events(table, defs).select(*OUT)


TREND = """trend AS (SELECT property_id, 'daily_missing_days' AS id, 'anomaly' AS type, CASE WHEN count(*) > 1 THEN 'high' ELSE 'medium' END AS severity,
    'medium' AS confidence, 'tracking' AS scope, NULL AS entity FROM miss GROUP BY property_id
  UNION ALL SELECT property_id, 'daily_' || direction || '_' || date, 'anomaly', 'low', 'medium', 'property', NULL FROM (SELECT *, row_number() OVER (
    PARTITION BY property_id ORDER BY CASE metric WHEN 'sessions' THEN 1 WHEN 'keyEvents' THEN 2 ELSE 3 END, date) AS n FROM zs) WHERE n <= 6
  UNION ALL SELECT property_id, 'trend_within_period', 'observation', 'medium', 'high', 'property', NULL FROM drf WHERE abs(drift) >= 0.25)"""


@register("fw18_fw20_trend_findings", g.with_(*SESS, DAILY, CAL, MISS, ZS, DRIFT, TREND) + "SELECT * FROM trend")
def fw18_fw20_trend_findings(spark, sf):
    cur = stage(daily(spark, sf).filter("period = 'current'"), "daily")
    return web_findings.trend_findings(
        timeseries.missing_days(days(spark, sf), cur), timeseries.web_anomalies(cur, ["sessions", "keyEvents", "totalRevenue"]),
        timeseries.drift(cur)).select(*OUT)


ECOM = """ecf AS (SELECT property_id, 'ecom_step_drop:' || key AS id, 'weakness' AS type, CASE WHEN step_rate_previous - step_rate_current >= 10 THEN 'high' ELSE 'medium' END AS severity,
    'high' AS confidence, 'ecommerce' AS scope, NULL AS entity FROM fun WHERE step_rate_previous - step_rate_current >= 5 AND step_rate_previous > 0
  UNION ALL SELECT property_id, 'ecom_aov_vs_volume', 'observation', 'medium', 'high', 'ecommerce', NULL FROM kj WHERE shop AND averagePurchaseRevenue_avail = 'available'
    AND transactions_avail = 'available' AND averagePurchaseRevenue_material AND transactions_material AND averagePurchaseRevenue_dir <> transactions_dir)"""


@register("fw21_ecommerce_findings", g.with_(*KW, FUNNEL, ECOM) + "SELECT * FROM ecf")
def fw21_ecommerce_findings(spark, sf):
    kpis = web.kpis_wide(web.totals(sessions(spark, sf)))
    return web_findings.ecommerce_findings(web.funnel(kpis), kpis).select(*OUT)


@register("fw22_geo_findings", g.with_(*SEGS, CAPPED, breakdown_sql("property_id", "sess", "tot"), BASES,
  """geo AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY rank) AS n FROM capd WHERE dataset = 'geo_country' AND rank <= 8 AND cur_sessions >= 20)""",
  seg_change("(SELECT * FROM geo WHERE n BETWEEN 2 AND 4)")) + """
SELECT property_id, 'geo_move:' || key AS id, 'observation' AS type, 'low' AS severity, 'high' AS confidence, 'geo' AS scope, key AS entity
FROM schg JOIN bs USING (property_id) WHERE NOT base0 AND material AND abs(absolute_change) >= 20""")
def fw22_geo_findings(spark, sf):
    s = staged(spark, sf)
    kpis = web.kpis_wide(web.totals(s))
    top = web.geo_movers(web.all_breakdowns(s, {"geo_country": "country"}), 20)
    return web_findings.geo_findings(web.with_property_sessions(top, kpis)).select(*OUT)


def all_findings(spark, sf):
    s = staged(spark, sf)
    kpis = stage(web.kpis_wide(web.totals(s)), "kpis")
    cur = stage(web.daily(s).filter("period = 'current'"), "daily")
    gaps = timeseries.missing_days(days(spark, sf), cur)
    top = web.movers(web.all_breakdowns(s, {"channels": "channel"}), 5)
    found = union_findings([
        web_findings.kpi_findings(kpis),
        web_findings.segment_findings(web.with_property_sessions(top, kpis)),
        web_findings.event_findings(events_table(spark, sf), kpis.select("property_id", "baseline_empty")),
        web_findings.trend_findings(gaps, timeseries.web_anomalies(cur, ["sessions", "keyEvents", "totalRevenue"]), timeseries.drift(cur)),
        web_findings.ecommerce_findings(web.funnel(kpis), kpis),
    ])
    return web_findings.with_gap_caveat(found, gaps)


ALLF = [*KW, KPI_F, LONG, breakdown_sql("property_id, dataset, key", "sl", "seg"), CAPPED, *movers_sql("channels", 5), BASES, ACQ, DAILY, CAL, MISS,
        ZS, DRIFT, TREND, FUNNEL, ECOM, *EVT[1:], EVF,
        """allf AS (SELECT *, id = 'traffic_and_key_events_down' OR (id = 'engagement_rate_move' AND type = 'weakness') AS down FROM kpi_f
      UNION ALL SELECT * EXCLUDE (direction), type = 'weakness' FROM acq UNION ALL SELECT *, false FROM ev_f UNION ALL SELECT *, false FROM trend
      UNION ALL SELECT *, false FROM ecf)""",
        """capf AS (SELECT * REPLACE (CASE WHEN down AND type IN ('weakness', 'risk') AND property_id IN (SELECT property_id FROM miss) THEN 'low' ELSE confidence END AS confidence) FROM allf)"""]


@register("u2_fw23_web_findings", g.with_(*ALLF) + "SELECT * EXCLUDE (down) FROM capf")
def u2_fw23_web_findings(spark, sf):
    return all_findings(spark, sf).select(*OUT)


@register("r2_u5_web_recommendations", g.with_(*ALLF, """rc AS (
  SELECT property_id, id, 'High' AS priority, 'high' AS confidence, id AS akey FROM capf WHERE id IN ('traffic_up_key_events_down', 'key_event_rate_decline', 'revenue_down_traffic_stable')
  UNION ALL SELECT property_id, id, 'High', 'medium', id FROM capf WHERE id LIKE 'event_stopped:%' OR id = 'daily_missing_days'
  UNION ALL SELECT property_id, id, 'Medium', 'medium', id FROM capf WHERE id = 'event_volume_vs_traffic'
  UNION ALL SELECT property_id, id, CASE WHEN type = 'strength' THEN 'Medium' ELSE upper(severity[1]) || severity[2:] END, 'high', id FROM capf WHERE id LIKE 'acquisition_move:%'
  UNION ALL SELECT property_id, id, upper(severity[1]) || severity[2:], 'high', 'ecom' FROM capf WHERE id LIKE 'ecom_step_drop:%')""") + """
SELECT property_id, id AS from_finding, priority, confidence FROM (SELECT *, row_number() OVER (PARTITION BY property_id, akey
  ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, id) AS n FROM rc) WHERE n = 1""")
def r2_u5_web_recommendations(spark, sf):
    return web_findings.recommendations(all_findings(spark, sf)).select("property_id", "from_finding", "priority", "confidence")
