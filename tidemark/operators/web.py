"""Web analytics: sessions from events, property totals, breakdowns, events and funnel.

Events carry property_id, user_id, event_id, ts, date, event_name, is_key, revenue and the
dimensions channel, device, page, country.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import (
    ECOMMERCE_KPIS, ECOMMERCE_SIGNALS, FUNNEL_STEPS, UNATTRIBUTED_LABELS, WEB_CAPS, WEB_FLOORS, WEB_KPIS,
    WEB_MATERIAL_PCT, WEB_MIN_SESSIONS,
)
from ..functions.compare import Change, kpi_changes, standard_changes
from ..functions.nulls import rnd
from ..functions.text import compound_key
from .aggregate import attach, exact_median, present_in, ranked_all, top_per

SESSION_SUMS = ["duration_us", "events", "views", "clicks", "signups", "purchases", "key_events",
                "revenue"]


def sessionize(events: DataFrame, gap_minutes: int = 30, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Sessions per property and user, split where nothing happens for longer than the gap.

    A session takes its dimensions from its first event: channel, device, landing page, country and
    the columns named in `dimensions`.

    The source delivers sessions ready-made, so the gap is a parameter of ours. Events collapse to
    one row per user and gap-wide time bucket before the shuffle: all events of a bucket belong to
    one session, so this is exact, and a user who owns a third of all events arrives as a few
    thousand rows.
    """
    width = gap_minutes * 60 * 1_000_000
    buckets = events.withColumn(
        "bucket", F.expr(f"unix_micros(CAST(ts AS TIMESTAMP)) div {width}")
    ).groupBy("property_id", "user_id", "bucket").agg(
        F.min(F.struct("ts", "event_id", "channel", "device", "page", "country", *dimensions)).alias("first"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("events"),
        F.count_if(F.col("event_name") == "view").alias("views"),
        F.count_if(F.col("event_name") == "click").alias("clicks"),
        F.count_if(F.col("event_name") == "signup").alias("signups"),
        F.count_if(F.col("event_name") == "purchase").alias("purchases"),
        F.count_if("is_key").alias("key_events"),
        F.sum("revenue").alias("revenue"),
    )
    per_user = Window.partitionBy("property_id", "user_id").orderBy("bucket")
    numbered = buckets.withColumn("previous", F.lag("last_ts").over(per_user)).withColumn(
        "starts", F.expr(f"CASE WHEN previous IS NULL OR first.ts > previous + "
                         f"INTERVAL '{gap_minutes}' MINUTE THEN 1 ELSE 0 END")
    ).withColumn("session_no", F.sum("starts").over(
        per_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = ["events", "views", "clicks", "signups", "purchases", "key_events", "revenue"]
    sessions = numbered.groupBy("property_id", "user_id", "session_no").agg(
        F.min("first").alias("first"), F.max("last_ts").alias("ended"),
        *[F.sum(c).alias(c) for c in sums],
    )
    timed = sessions.selectExpr(
        "property_id", "user_id", "session_no", "first.ts AS started", "ended",
        "CAST(first.ts AS DATE) AS date", "first.channel AS channel", "first.device AS device",
        "first.page AS landing_page", "first.country AS country", *[f"first.{d} AS {d}" for d in dimensions], *sums,
        "unix_micros(CAST(ended AS TIMESTAMP)) - unix_micros(CAST(first.ts AS TIMESTAMP)) "
        "AS duration_us",
    )
    return timed.withColumn("engaged", F.expr(
        "duration_us > 10000000 OR key_events > 0 OR views >= 2"))


def with_first_seen(sessions: DataFrame) -> DataFrame:
    """First day, first channel and first purchase day of each user.

    The partitioning of the sessions is reused.
    """
    w = Window.partitionBy("property_id", "user_id")
    return sessions.withColumns({
        "first_seen": F.min("date").over(w),
        "first_channel": F.min_by("channel", "session_no").over(w),
        "first_purchase": F.min(F.expr("if(purchases > 0, date, null)")).over(w),
    })


def _user_level(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and user, conditional sums per period.

    Users are not additive, so each breakdown starts again from users. The rows are already
    partitioned by property and user: this step needs no shuffle.
    """
    aggs = []
    for p, f in (("cur_", "in_current"), ("prev_", "in_previous")):
        aggs += [
            F.count_if(f).alias(p + "sessions"),
            F.expr(f"count_if({f} AND engaged)").alias(p + "engaged"),
            F.expr(f"count_if({f} AND key_events > 0)").alias(p + "key_sessions"),
            F.expr(f"count_if({f} AND date = first_seen)").alias(p + "first_sessions"),
            F.expr(f"count_if({f} AND date = first_purchase)").alias(p + "first_purchases"),
            *[F.expr(f"sum(if({f}, {c}, 0))").alias(p + c) for c in SESSION_SUMS],
        ]
    return flagged.groupBy(*keys, "user_id").agg(*aggs)


def breakdown(flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Web metrics of both periods per key. A period without a session for the key is null."""
    users = _user_level(flagged, keys)
    aggs = []
    for p in ("cur_", "prev_"):
        aggs += [
            F.sum(p + "sessions").alias(p + "rows"),
            F.sum(p + "engaged").alias(p + "n_engaged"),
            F.sum(p + "key_sessions").alias(p + "n_key_sessions"),
            F.count_if(F.expr(f"{p}sessions > 0")).alias(p + "n_users"),
            F.count_if(F.expr(f"{p}engaged > 0")).alias(p + "n_active"),
            F.count_if(F.expr(f"{p}first_sessions > 0")).alias(p + "n_new"),
            F.count_if(F.expr(f"{p}key_sessions > 0")).alias(p + "n_key_users"),
            F.count_if(F.expr(f"{p}purchases > 0")).alias(p + "n_purchasers"),
            F.count_if(F.expr(f"{p}first_purchases > 0")).alias(p + "n_first_purchasers"),
            # Microseconds of very many sessions outgrow a long.
            F.sum(F.col(p + "duration_us").cast("decimal(20,0)")).alias(p + "s_duration_us"),
            *[F.sum(p + c).alias(p + "s_" + c) for c in SESSION_SUMS if c != "duration_us"],
        ]
    sums = users.groupBy(*keys).agg(*aggs).filter("cur_rows > 0 OR prev_rows > 0")
    columns = [*keys, "cur_rows", "prev_rows"]
    for p in ("cur_", "prev_"):
        columns += [f"CASE WHEN {p}rows > 0 THEN {sql} END AS {p}{name}"
                    for name, sql in _metric_sql(p).items()]
    return sums.selectExpr(*columns).withColumn("present_in", present_in())


def _metric_sql(p: str) -> dict[str, str]:
    def d(a, b):
        return f"try_divide(CAST({p}{a} AS DOUBLE), CAST({p}{b} AS DOUBLE))"

    return {
        "activeUsers": f"{p}n_active", "totalUsers": f"{p}n_users", "newUsers": f"{p}n_new",
        "sessions": f"{p}rows", "engagedSessions": f"{p}n_engaged",
        "engagementRate": f"{d('n_engaged', 'rows')} * 100.0D",
        "bounceRate": f"try_divide(CAST({p}rows - {p}n_engaged AS DOUBLE), "
                      f"CAST({p}rows AS DOUBLE)) * 100.0D",
        "averageSessionDuration": f"try_divide(CAST({p}s_duration_us AS DOUBLE), "
                                  f"CAST({p}rows AS DOUBLE)) / 1000000.0D",
        "screenPageViews": f"{p}s_views",
        "screenPageViewsPerSession": d("s_views", "rows"),
        "sessionsPerUser": d("rows", "n_users"),
        "eventCount": f"{p}s_events", "eventsPerSession": d("s_events", "rows"),
        "keyEvents": f"{p}s_key_events",
        "sessionKeyEventRate": f"{d('n_key_sessions', 'rows')} * 100.0D",
        "userKeyEventRate": f"{d('n_key_users', 'n_active')} * 100.0D",
        "totalRevenue": f"{p}s_revenue", "purchaseRevenue": f"{p}s_revenue",
        "transactions": f"{p}s_purchases", "ecommercePurchases": f"{p}s_purchases",
        "totalPurchasers": f"{p}n_purchasers", "firstTimePurchasers": f"{p}n_first_purchasers",
        "purchaserRate": f"{d('n_purchasers', 'n_active')} * 100.0D",
        "averagePurchaseRevenue": d("s_revenue", "s_purchases"),
        "averageRevenuePerUser": d("s_revenue", "n_active"),
        "itemsViewed": f"{p}s_views", "addToCarts": f"{p}s_clicks",
        "itemsAddedToCart": f"{p}s_clicks", "checkouts": f"{p}s_signups",
        "itemsCheckedOut": f"{p}s_signups", "itemsPurchased": f"{p}s_purchases",
        "cartToViewRate": f"{d('s_clicks', 's_views')} * 100.0D",
        "purchaseToViewRate": f"{d('s_purchases', 's_views')} * 100.0D",
    }


def totals(flagged: DataFrame) -> DataFrame:
    return breakdown(flagged, ["property_id"])


def ecommerce_state(property_totals: DataFrame) -> DataFrame:
    """active with any positive signal, no_data with only zeros, unavailable without values."""
    signals = [f"{p}{m}" for p in ("cur_", "prev_")
               for m in ECOMMERCE_SIGNALS]
    positive = " OR ".join(f"coalesce({c} > 0, false)" for c in signals)
    present = f"coalesce({', '.join(f'CAST({c} AS DOUBLE)' for c in signals)}) IS NOT NULL"
    return property_totals.withColumn("ecommerce_state", F.expr(
        f"CASE WHEN {positive} THEN 'active' WHEN {present} THEN 'no_data' ELSE 'unavailable' END"))


def kpis_wide(property_totals: DataFrame) -> DataFrame:
    """All KPIs as structs; sessions that fell while outcomes rose are a mix change."""
    state = ecommerce_state(property_totals)
    changed = kpi_changes(state, WEB_KPIS + ECOMMERCE_KPIS, WEB_FLOORS, WEB_MATERIAL_PCT)
    mixed = F.expr(
        "k_sessions.direction = 'down' AND (k_keyEvents.verdict = 'improved' OR "
        "(ecommerce_state = 'active' AND k_totalRevenue.verdict = 'improved'))")
    sessions = F.col("k_sessions").withField(
        "verdict", F.when(mixed, "ambiguous").otherwise(F.col("k_sessions.verdict")))
    return changed.select(
        "property_id", "ecommerce_state",
        F.expr("coalesce(prev_sessions, 0) = 0").alias("baseline_empty"),
        sessions.alias("k_sessions"),
        *[f"k_{k.key}" for k in WEB_KPIS + ECOMMERCE_KPIS if k.key != "sessions"],
    )


def derive_missing(totals_: DataFrame) -> DataFrame:
    """Ratios the source left out, from figures it returned, and which ones were derived.

    Events per session is always derived; the other two only where they are absent.
    """
    per_session = "try_divide(CAST(eventCount AS DOUBLE), CAST(sessions AS DOUBLE))"
    views = "try_divide(CAST(screenPageViews AS DOUBLE), CAST(sessions AS DOUBLE))"
    users = "try_divide(CAST(sessions AS DOUBLE), CAST(totalUsers AS DOUBLE))"
    return totals_.withColumn("derived", F.expr(
        f"array_compact(array(CASE WHEN {per_session} IS NOT NULL THEN 'eventsPerSession' END, "
        f"CASE WHEN screenPageViewsPerSession IS NULL AND {views} IS NOT NULL "
        f"THEN 'screenPageViewsPerSession' END, "
        f"CASE WHEN sessionsPerUser IS NULL AND {users} IS NOT NULL THEN 'sessionsPerUser' END))"
    )).withColumns({
        "eventsPerSession": F.expr(per_session),
        "screenPageViewsPerSession": F.expr(f"coalesce(screenPageViewsPerSession, {views})"),
        "sessionsPerUser": F.expr(f"coalesce(sessionsPerUser, {users})"),
    })


def all_breakdowns(flagged: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """Every breakdown in one pass: a session is unnested into one row per dataset and key.

    `dimensions` maps a dataset name to a column. This is what GROUPING SETS would expand to, with
    the dataset name and the key in columns of their own.
    """
    rows = ", ".join(
        f"struct('{name}' AS dataset, CAST({column} AS STRING) AS key)"
        for name, column in dimensions.items())
    return breakdown(flagged.select("*", F.inline(F.expr(f"array({rows})"))),
                     ["property_id", "dataset", "key"])


def ranked(segments: DataFrame) -> DataFrame:
    """All rows with their rank in the dataset's own metric, null and zero last, and whether the
    source's list would have been full. For lists that are shown; figures use the full breakdown."""
    metric = " ".join(f"WHEN '{d}' THEN CAST(cur_{m} AS DOUBLE)" for d, (_, m) in WEB_CAPS.items()
                      if f"cur_{m}" in segments.columns)
    cap = " ".join(f"WHEN '{d}' THEN {k}" for d, (k, _) in WEB_CAPS.items())
    # Descending, and nulls last, as one ascending number.
    sized = segments.withColumn("sort_value", F.expr(f"CASE dataset {metric} END")).withColumn(
        "_down", F.coalesce(-F.col("sort_value"), F.lit(float("inf"))))
    placed = ranked_all(sized, ["property_id", "dataset"], ["_down", "key"], "rank").drop("_down")
    sizes = segments.groupBy("property_id", "dataset").agg(F.count("*").alias("_rows"))
    return attach(placed, sizes, ["property_id", "dataset"], ["key"]).withColumn(
        "hit_cap", F.expr(f"_rows >= CASE dataset {cap} END")).drop("_rows")


def segment_changes(segments: DataFrame) -> DataFrame:
    """Change of sessions and key events per segment."""
    return standard_changes(segments, [
        Change("d_sessions", "cur_sessions", "prev_sessions", "int", "higher"),
        Change("d_keyEvents", "cur_keyEvents", "prev_keyEvents", "decimal", "higher"),
    ], WEB_FLOORS, WEB_MATERIAL_PCT)


def movers(segments: DataFrame, k: int) -> DataFrame:
    """Material or new segments by the size of their move."""
    moving = segment_changes(segments).filter(
        "d_sessions.material OR d_sessions.verdict = 'new'")
    if "rank" in moving.columns:
        moving = moving.drop("rank")
    order = [F.abs(F.coalesce("d_sessions.absolute_change", F.lit(0.0))).desc(), F.col("key").asc()]
    return top_per(moving, ["property_id"], order, k)


def judged_landing_pages(pages: DataFrame, min_sessions: int = WEB_MIN_SESSIONS, first: int = 15) -> DataFrame:
    """Landing pages with enough sessions, with their property's median engagement.

    The median is exact over unrounded rates, for any number of pages. `judged_rank` numbers the first pages by sessions and is null for the rest.
    """
    judged = pages.filter(F.col("cur_sessions") >= min_sessions).drop("rank")
    median = exact_median(judged, ["property_id"], "cur_engagementRate", "median_engagement").drop("rows")
    order = [F.col("cur_sessions").desc_nulls_last(), F.col("key").asc()]
    leading = top_per(judged, ["property_id"], order, first, "judged_rank").select("property_id", "key", "judged_rank")
    with_median = attach(judged, median, ["property_id"], ["key"])
    return with_median.join(leading, ["property_id", "key"], "left")


def event_table(events: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Event counts of both periods with key-event status.

    An event is a key event when a definition names it or when it counted as one. `definitions`
    has property_id, event_name and `declared`; a property has a handful of them.
    """
    per_user = events.groupBy("property_id", "event_name", "user_id").agg(
        F.count_if("in_current").alias("c"), F.count_if("in_previous").alias("p"),
        F.expr("count_if(in_current AND is_key)").alias("k"))
    table = per_user.groupBy("property_id", "event_name").agg(
        F.expr("nullif(sum(c), 0)").alias("cur_eventCount"),
        F.expr("nullif(sum(p), 0)").alias("prev_eventCount"),
        F.sum("k").alias("cur_keyEvents"),
        F.count_if(F.expr("c > 0")).alias("cur_totalUsers"))
    changed = standard_changes(table, [
        Change("d_count", "cur_eventCount", "prev_eventCount", "int", "context"),
    ], WEB_FLOORS, WEB_MATERIAL_PCT)
    if definitions is None:
        return changed.withColumns({
            "is_key_event": F.col("cur_keyEvents") > 0, "declared_primary": F.lit(False)})
    joined = changed.join(definitions.withColumn("_defined", F.lit(True)),
                          ["property_id", "event_name"], "left")
    return joined.withColumns({
        "is_key_event": F.expr("coalesce(_defined, false) OR cur_keyEvents > 0"),
        "declared_primary": F.expr("coalesce(declared, false)"),
    }).drop("_defined", "declared")


def event_breakdown(events: DataFrame, keys: dict[str, str], dataset: str) -> DataFrame:
    """Event-level breakdown (pages, items): several dimensions joined to one key.

    `keys` maps output columns to SQL text over marked events. Users are counted through one row
    per key and user.
    """
    named = events.select("*", *[F.expr(sql).alias(name) for name, sql in keys.items()])
    groups = ["property_id", *keys]
    aggs = []
    for p, f in (("cur_", "in_current"), ("prev_", "in_previous")):
        aggs += [
            F.count_if(f).alias(p + "eventCount"),
            F.expr(f"count_if({f} AND event_name = 'view')").alias(p + "screenPageViews"),
            F.expr(f"count_if({f} AND is_key)").alias(p + "keyEvents"),
            F.expr(f"count_if({f} AND event_name = 'click')").alias(p + "itemsAddedToCart"),
            F.expr(f"count_if({f} AND event_name = 'purchase')").alias(p + "itemsPurchased"),
            F.expr(f"sum(if({f}, revenue, 0))").alias(p + "itemRevenue"),
        ]
    per_user = named.groupBy(*groups, "user_id").agg(*aggs)
    names = ["eventCount", "screenPageViews", "keyEvents", "itemsAddedToCart", "itemsPurchased",
             "itemRevenue"]
    sums = per_user.groupBy(*groups).agg(*[
        c for p in ("cur_", "prev_") for c in (
            *[F.sum(p + n).alias(p + n) for n in names],
            F.count_if(F.expr(f"{p}eventCount > 0")).alias(p + "totalUsers"))])
    present = sums.filter("cur_eventCount > 0 OR prev_eventCount > 0")
    return present.select(
        "property_id", F.lit(dataset).alias("dataset"),
        compound_key(*[F.col(k).cast("string") for k in keys]).alias("key"),
        *[F.expr(f"if({p}eventCount > 0, {p}{n}, null)").alias(p + n)
          for p in ("cur_", "prev_") for n in (*names, "totalUsers")])


def daily(flagged: DataFrame) -> DataFrame:
    """Daily web figures per property and period, from sessions of either window."""
    tagged = flagged.filter("in_current OR in_previous").withColumn(
        "period", F.expr("explode(array_compact(array(CASE WHEN in_current THEN 'current' END, "
                         "CASE WHEN in_previous THEN 'previous' END)))"))
    return tagged.groupBy("property_id", "period", "date").agg(
        F.count("*").alias("sessions"), F.count_if("engaged").alias("engagedSessions"),
        F.sum("key_events").alias("keyEvents"), F.sum("revenue").alias("totalRevenue"),
        F.sum("views").alias("screenPageViews"), F.sum("events").alias("eventCount"))


def funnel(kpis: DataFrame) -> DataFrame:
    """Item funnel of active shops: each step's rate against the previous available step."""
    rows = ", ".join(
        f"struct({i} AS step, '{key}' AS key, '{label}' AS label, "
        f"k_{key}.availability AS availability, k_{key}.current AS current, "
        f"k_{key}.previous AS previous)"
        for i, (key, label) in enumerate(FUNNEL_STEPS, start=1))
    steps = kpis.filter("ecommerce_state = 'active'").selectExpr(
        "property_id", f"inline(array({rows}))").filter("availability = 'available'")
    w = Window.partitionBy("property_id").orderBy("step")
    return steps.withColumns({
        "step_rate_current": F.try_divide("current", F.lag("current").over(w)) * 100.0,
        "step_rate_previous": F.try_divide("previous", F.lag("previous").over(w)) * 100.0,
    }).drop("availability")


def device_gap(devices: DataFrame, min_sessions: int = WEB_MIN_SESSIONS) -> DataFrame:
    """Key-event rate of desktop against mobile where both have enough sessions."""
    rate = ("coalesce(cur_sessionKeyEventRate, try_divide(CAST(cur_keyEvents AS DOUBLE), "
            "CAST(cur_sessions AS DOUBLE)) * 100.0D)")
    sides = devices.groupBy("property_id").agg(*[
        F.expr(f"max(if(lower(key) = '{d}', {sql}, null))").alias(f"{d}_{n}")
        for d in ("desktop", "mobile")
        for n, sql in (("rate", rate), ("sessions", "cur_sessions"))])
    sized = sides.filter(
        f"desktop_rate IS NOT NULL AND mobile_rate IS NOT NULL "
        f"AND desktop_sessions >= {min_sessions} AND mobile_sessions >= {min_sessions}")
    return sized.withColumn("gap", F.expr("desktop_rate - mobile_rate")).withColumn(
        "relative", F.expr("try_divide(abs(gap), greatest(desktop_rate, mobile_rate)) * 100.0D")
    ).filter("abs(gap) >= 1 AND relative >= 25")


def unattributed(segments: DataFrame, datasets: list[str]) -> DataFrame:
    """Share of sessions under labels that name no source, per dataset."""
    labels = ", ".join(f"'{x}'" for x in UNATTRIBUTED_LABELS)
    rows = segments.filter(F.col("dataset").isin(datasets))
    whole = rows.groupBy("property_id", "dataset").agg(
        F.sum(F.coalesce("cur_sessions", F.lit(0))).alias("whole"))
    named = rows.filter(f"lower(trim(coalesce(key, ''))) IN ({labels})")
    return named.join(whole, ["property_id", "dataset"]).filter("whole > 0").withColumn(
        "share", F.expr("CAST(coalesce(cur_sessions, 0) AS DOUBLE) / CAST(whole AS DOUBLE) * 100.0D")
    ).filter("share >= 5").selectExpr(
        "property_id", "dataset", "key", "share",
        "if(share >= 20, 'fail', 'warn') AS status")


def direct_surge(channels: DataFrame) -> DataFrame:
    """Direct sessions up by 30 % and 100: as often lost attribution as demand."""
    return channels.filter(
        "lower(key) = 'direct' AND cur_sessions > 0 AND prev_sessions > 0 "
        "AND (cur_sessions - prev_sessions) / prev_sessions >= 0.30 "
        "AND cur_sessions - prev_sessions >= 100"
    ).select("property_id", "cur_sessions", "prev_sessions")


def new_user_share(property_totals: DataFrame) -> DataFrame:
    """New users as a share of users, both periods and the shift in points."""
    return property_totals.selectExpr(
        "property_id",
        "try_divide(CAST(cur_newUsers AS DOUBLE), CAST(cur_totalUsers AS DOUBLE)) * 100.0D AS cur_share",
        "try_divide(CAST(prev_newUsers AS DOUBLE), CAST(prev_totalUsers AS DOUBLE)) * 100.0D AS prev_share",
    ).withColumn("shift", rnd(F.expr("cur_share - prev_share"), 4))


def geo_movers(countries: DataFrame, min_sessions: int = WEB_MIN_SESSIONS) -> DataFrame:
    """Second to fourth big market of the first eight, when it moved materially."""
    order = [F.col("cur_sessions").desc_nulls_last(), F.col("key").asc()]
    big = top_per(countries.drop("rank"), ["property_id"], order, 8, "n").filter(f"cur_sessions >= {min_sessions}")
    placed = segment_changes(big).filter("n BETWEEN 2 AND 4")
    return placed.filter(
        f"d_sessions.material AND abs(d_sessions.absolute_change) >= {min_sessions}")


def with_property_sessions(rows: DataFrame, kpis: DataFrame) -> DataFrame:
    """Property sessions and the baseline flag on segment rows."""
    return attach(
        rows, kpis.selectExpr("property_id", "k_sessions.current AS total_sessions",
                              "baseline_empty"),
        ["property_id"], ["key"])
