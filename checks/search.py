"""Registered queries over organic-search facts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.catalog import SEARCH_FLOORS, SEARCH_KPIS
from tidemark.functions.compare import long_kpis
from tidemark.operators import periods, search, search_findings, timeseries
from tidemark.operators.periods import mark
from tidemark.session import stage

from . import sqlgen as g
from .views import SEARCH_SQL, YEAR_WINDOWS, search_stats, table

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


def marked(spark, sf):
    return mark(search_stats(spark, sf), YEAR_WINDOWS)


def web_only(spark, sf):
    return marked(spark, sf).filter("search_type = 'web'")


def totals(rows):
    return search.two_sided(rows, ["property_id"])


POS = {"clicks": "clicks", "impressions": "impressions",
       "pos_num": "CASE WHEN position IS NOT NULL AND impressions <> 0 THEN position * impressions END",
       "pos_den": "CASE WHEN position IS NOT NULL AND impressions <> 0 THEN impressions END"}
WEBROWS = "sw AS (SELECT * FROM searchw WHERE search_type = 'web')"


def sides_sql(source, keys, name, where=""):
    cols = []
    for p in ("cur_", "prev_"):
        cols += [f"{g.div(p + 'clicks', p + 'impressions')} * 100.0 AS {p}ctr",
                 f"{g.div(p + 'pos_num', p + 'pos_den')} AS {p}average_position"]
    return (f"{name} AS (SELECT *, {', '.join(cols)} FROM (SELECT {keys}, {g.two(POS)} FROM {source} "
            f"{where} GROUP BY {keys}))")


SPECS = [(k.key, k.label, k.unit, k.better, SEARCH_FLOORS[k.key]) for k in SEARCH_KPIS]
KPIS = [SEARCH_SQL, WEBROWS, sides_sql("sw", "property_id", "tot"), g.unpivot("tot", "property_id", SPECS),
        g.search_chg("kl")]
KPI_OUT = """SELECT {keys}, key, cur4 AS current, prev4 AS previous, absolute_change, percent_change, availability,
  direction, verdict, material FROM chg"""
KPI_COLS = ["key", "current", "previous", "absolute_change", "percent_change", "availability", "direction",
            "verdict", "material"]


@register("c2_search_kpis", g.with_(*KPIS) + KPI_OUT.format(keys="property_id"))
def c2_search_kpis(spark, sf):
    k = search.kpis_wide(totals(web_only(spark, sf)))
    return long_kpis(k, SEARCH_KPIS, ["property_id"]).select("property_id", *KPI_COLS)


@register("u7_c8_search_surfaces", g.with_(
    SEARCH_SQL, sides_sql("searchw", "property_id, search_type", "tot"),
    g.unpivot("tot", "property_id, search_type", SPECS), g.search_chg("kl")) + KPI_OUT.format(keys="property_id, search_type"))
def u7_c8_search_surfaces(spark, sf):
    t = search.two_sided(marked(spark, sf), ["property_id", "search_type"])
    k = search.kpis_wide(t, ("property_id", "search_type"))
    return long_kpis(k, SEARCH_KPIS, ["property_id", "search_type"]).select("property_id", "search_type", *KPI_COLS)


# --- dimension records ----------------------------------------------------------------------

def band_sql(x):
    return (f"CASE WHEN {x} < 0 THEN NULL WHEN {x} < 3.5 THEN '1-3' WHEN {x} < 10.5 THEN '4-10' "
            f"WHEN {x} < 20.5 THEN '11-20' WHEN {x} < 1e9 THEN '21+' END")


def records_sql(key, source="sw", name="rec"):
    d = "(cur_average_position - prev_average_position)"
    return [
        sides_sql(source, f"property_id, {key}", f"{name}0", f"WHERE {key} IS NOT NULL"),
        f"""{name} AS (SELECT property_id, {key}, CASE WHEN cur_rows > 0 AND prev_rows > 0 THEN 'both'
      WHEN cur_rows > 0 THEN 'current only' ELSE 'previous only' END AS present_in,
    {g.rnd('cur_clicks')} AS clicks, {g.rnd('cur_impressions')} AS impressions, {g.rnd('cur_ctr', 2)} AS ctr,
    {g.rnd('cur_average_position', 1)} AS position, {g.rnd('prev_clicks')} AS previous_clicks,
    {g.rnd('prev_impressions')} AS previous_impressions, {g.rnd('prev_ctr', 2)} AS previous_ctr,
    {g.rnd('prev_average_position', 1)} AS previous_position, {g.rnd('cur_clicks - prev_clicks')} AS clicks_change,
    {g.rnd('(cur_clicks - prev_clicks) / nullif(abs(prev_clicks), 0) * 100.0', 1)} AS clicks_change_pct,
    {g.rnd('cur_impressions - prev_impressions')} AS impressions_change,
    {g.rnd('(cur_impressions - prev_impressions) / nullif(abs(prev_impressions), 0) * 100.0', 1)} AS impressions_change_pct,
    {g.rnd('cur_ctr - prev_ctr', 2)} AS ctr_change_points, {g.rnd(d, 1)} AS position_change,
    CASE WHEN {d} < 0 THEN 'improved' WHEN {d} > 0 THEN 'worsened' WHEN {d} = 0 THEN 'flat' END AS position_moved,
    {band_sql('cur_average_position')} AS band FROM {name}0)""",
    ]


FIG = [SEARCH_SQL, WEBROWS, sides_sql("sw", "property_id", "tot"),
       """fig AS (SELECT property_id, cur_clicks AS p_clicks, cur_impressions AS p_impressions,
      greatest(100.0::DOUBLE, coalesce(round_even(cur_impressions * 0.0005::DOUBLE, 0), 0)) AS floor,
      greatest(10.0::DOUBLE, floor(coalesce(cur_clicks, 0) * 0.005::DOUBLE)) AS click_floor FROM tot)"""]
RECORD_COLS = ["present_in", "clicks", "impressions", "ctr", "position", "previous_clicks", "previous_impressions",
               "previous_ctr", "previous_position", "clicks_change", "clicks_change_pct", "impressions_change",
               "impressions_change_pct", "ctr_change_points", "position_change", "position_moved", "band"]
RC = ", ".join(RECORD_COLS)


def _records(key):
    sql = g.with_(SEARCH_SQL, WEBROWS, *records_sql(key)) + f"SELECT property_id, {key}, {RC} FROM rec"

    def run(spark, sf):
        return search.records(web_only(spark, sf), [key])
    return sql, run


for _name, _key in (("c9_j1_query_records", "query"), ("a12_page_records", "page"), ("a12_device_records", "device"),
                    ("a12_country_records", "country"), ("a12_appearance_records", "appearance")):
    _sql, _run = _records(_key)
    register(_name, _sql)(_run)


@register("an7_property_floors", g.with_(*FIG) + "SELECT property_id, p_clicks, p_impressions, floor, click_floor FROM fig")
def an7_property_floors(spark, sf):
    return search.property_figures(totals(web_only(spark, sf)))


@register("a13_reaggregated_slices", g.with_(SEARCH_SQL, WEBROWS) + f"""
SELECT property_id, query, sum(clicks)::DOUBLE AS clicks, sum(impressions)::DOUBLE AS impressions,
  {g.div('sum(clicks)', 'sum(impressions)')} AS ctr, {g.div('sum(position * impressions)', 'sum(impressions)')} AS position
FROM sw WHERE in_current GROUP BY 1, 2""")
def a13_reaggregated_slices(spark, sf):
    rows = search.with_position_sums(web_only(spark, sf).filter("in_current"))
    slices = search.reaggregate(rows.withColumn("slice", F.date_trunc("month", "date")), ["property_id", "query", "slice"])
    whole = search.reaggregate(slices, ["property_id", "query"])
    return whole.select("property_id", "query", F.col("clicks").cast("double").alias("clicks"),
                        F.col("impressions").cast("double").alias("impressions"), "ctr", "position")


@register("a04_weighted_position", g.with_(SEARCH_SQL) + f"""
SELECT property_id, device, {g.div('sum(position * impressions)', 'sum(impressions)')} AS position,
  sum(impressions)::DOUBLE AS weight FROM search GROUP BY 1, 2""")
def a04_weighted_position(spark, sf):
    from tidemark.functions.nulls import weight_used, weighted_mean
    return search_stats(spark, sf).groupBy("property_id", "device").agg(
        weighted_mean(F.col("position"), F.col("impressions")).alias("position"),
        weight_used(F.col("position"), F.col("impressions")).alias("weight"))


BENCH = """bench AS (SELECT property_id, band, round_even((max(CASE WHEN rn = (n + 1) // 2 THEN ctr END)
    + max(CASE WHEN rn = (n + 2) // 2 THEN ctr END)) / 2.0 * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS median_ctr, max(n) AS rows
  FROM (SELECT property_id, band, ctr, row_number() OVER (PARTITION BY property_id, band ORDER BY ctr) AS rn,
      count(*) OVER (PARTITION BY property_id, band) AS n
    FROM rec WHERE impressions >= 10 AND ctr IS NOT NULL AND band IS NOT NULL) GROUP BY 1, 2 HAVING max(n) >= 8)"""


@register("a20_ctr_benchmarks", g.with_(SEARCH_SQL, WEBROWS, *records_sql("query"), BENCH) +
          "SELECT property_id, band, median_ctr, rows FROM bench")
def a20_ctr_benchmarks(spark, sf):
    return search.ctr_benchmarks(search.records(web_only(spark, sf), ["query"]))


def lists(rows, key):
    """The ranked lists of one dimension, from one scan of the facts."""
    sides = stage(search.two_sided(rows, ["property_id", key]), f"sides-{key}")
    recs = search.clean(sides, [key])
    fig = search.property_figures(search.totals_of(sides))
    return {
        "losers": search.click_movers(recs, fig, key, "loss"),
        "winners": search.click_movers(recs, fig, key, "gain"),
        "visibility": search.visibility_losses(recs, fig, key),
        "ctr": search.ctr_opportunities(recs, fig, search.ctr_benchmarks(recs), key),
        "ranking": search.ranking_opportunities(recs, fig, key),
    }, search.concentration(recs, key, "loss")


def ctr_ops_sql(key, name="ctr_ops", rec="rec"):
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY clicks_at_band_median DESC, {key}) AS rank
  FROM (SELECT r.*, median_ctr, {g.rnd('median_ctr - ctr', 2)} AS ctr_gap_points,
      {g.rnd('impressions * (median_ctr - ctr) / 100.0', 0)} AS clicks_at_band_median,
      {g.rnd('impressions * (median_ctr - ctr) / 100.0 / nullif(clicks, 0)', 1)} AS ceiling_ratio,
      coalesce(impressions * (median_ctr - ctr) / 100.0 / nullif(clicks, 0) > 3, true) AS ceiling_is_speculative
    FROM {rec} r JOIN fig USING (property_id) JOIN bench USING (property_id, band)
    WHERE impressions > 0 AND impressions >= floor AND ctr IS NOT NULL AND median_ctr <> 0 AND ctr < median_ctr * 0.7
      AND impressions * (median_ctr - ctr) / 100.0 >= 5) QUALIFY rank <= 10)"""


def rank_ops_sql(key, name="rank_ops", rec="rec"):
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY opportunity_score DESC, {key}) AS rank
  FROM (SELECT r.*, {g.rnd('''impressions * (0.6::DOUBLE + 0.4::DOUBLE * greatest(0.0::DOUBLE, (20.5::DOUBLE - position) / 20.5::DOUBLE))
        * (1.0::DOUBLE + 0.25::DOUBLE * coalesce(CASE WHEN position_change IS NULL THEN NULL
          ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -position_change / 5.0::DOUBLE)) END, 0.0::DOUBLE))''', 0)} AS opportunity_score
    FROM {rec} r JOIN fig USING (property_id) WHERE impressions > 0 AND impressions >= floor AND position IS NOT NULL
      AND band IN ('4-10', '11-20')) QUALIFY rank <= 10)"""


def movers_sql(key, direction, name, rec="rec"):
    cond, order = ("> 0", "DESC") if direction == "gain" else ("< 0", "ASC")
    return f"""{name} AS (SELECT r.*, row_number() OVER (PARTITION BY property_id ORDER BY clicks_change {order}, {key}) AS rank
  FROM {rec} r JOIN fig USING (property_id) WHERE clicks_change {cond} AND abs(clicks_change) >= click_floor QUALIFY rank <= 10)"""


KIND = """CASE (CASE WHEN impressions_change < 0 AND abs(impressions_change) >= greatest(100.0, coalesce(previous_impressions, 0) * 0.2) THEN 1 ELSE 0 END
    + CASE WHEN coalesce(position_change, 0) > 0.6 THEN 1 ELSE 0 END + CASE WHEN coalesce(ctr_change_points, 0) < -0.2 THEN 1 ELSE 0 END)
  WHEN 0 THEN 'unclear' WHEN 1 THEN
    CASE WHEN impressions_change < 0 AND abs(impressions_change) >= greatest(100.0, coalesce(previous_impressions, 0) * 0.2) THEN 'visibility'
      WHEN coalesce(position_change, 0) > 0.6 THEN 'ranking' ELSE 'ctr' END ELSE 'mixed' END"""


def vis_sql(key, name="vis", rec="rec"):
    return f"""{name} AS (SELECT r.*, {KIND} AS loss_kind, row_number() OVER (PARTITION BY property_id ORDER BY impressions_change, {key}) AS rank
  FROM {rec} r JOIN fig USING (property_id) WHERE impressions_change < 0 AND previous_impressions > 0 AND previous_impressions >= floor
    AND abs(impressions_change) >= greatest(100.0, previous_impressions * 0.25) QUALIFY rank <= 10)"""


def conc_sql(key, direction, name="conc", rec="rec"):
    cond, order = ("> 0", "DESC") if direction == "gain" else ("< 0", "ASC")
    return f"""{name} AS (SELECT property_id, sum(clicks_change) AS total_change, sum(clicks_change) FILTER (rn <= 5) AS top_n_change,
    count(*) FILTER (rn <= 5) AS top_n, string_agg({key}, ',' ORDER BY rn) FILTER (rn <= 5) AS entities,
    {g.rnd('abs(sum(clicks_change) FILTER (rn <= 5)) / nullif(abs(sum(clicks_change)), 0) * 100.0', 1)} AS top_n_share_pct
  FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY clicks_change {order}, {key}) AS rn
    FROM {rec} WHERE clicks_change {cond}) GROUP BY property_id)"""


QREC = FIG + records_sql("query")


@register("an8_ctr_opportunities", g.with_(*QREC, BENCH, ctr_ops_sql("query")) + """
SELECT property_id, query, impressions, ctr, band, median_ctr, ctr_gap_points, clicks_at_band_median, ceiling_ratio,
  ceiling_is_speculative, rank FROM ctr_ops""")
def an8_ctr_opportunities(spark, sf):
    return lists(web_only(spark, sf), "query")[0]["ctr"].select(
        "property_id", "query", "impressions", "ctr", "band", "median_ctr", "ctr_gap_points", "clicks_at_band_median",
        "ceiling_ratio", "ceiling_is_speculative", "rank")


@register("an9_ranking_opportunities", g.with_(*QREC, rank_ops_sql("query")) + """
SELECT property_id, query, impressions, position, band, position_change, opportunity_score, rank FROM rank_ops""")
def an9_ranking_opportunities(spark, sf):
    return lists(web_only(spark, sf), "query")[0]["ranking"].select(
        "property_id", "query", "impressions", "position", "band", "position_change", "opportunity_score", "rank")


@register("an10_win11_click_losers", g.with_(*QREC, movers_sql("query", "loss", "m")) +
          "SELECT property_id, query, clicks_change, clicks_change_pct, rank FROM m")
def an10_win11_click_losers(spark, sf):
    return lists(web_only(spark, sf), "query")[0]["losers"].select(
        "property_id", "query", "clicks_change", "clicks_change_pct", "rank")


@register("an10_win11_click_winners", g.with_(*FIG, *records_sql("page"), movers_sql("page", "gain", "m")) +
          "SELECT property_id, page, clicks_change, clicks_change_pct, rank FROM m")
def an10_win11_click_winners(spark, sf):
    return lists(web_only(spark, sf), "page")[0]["winners"].select(
        "property_id", "page", "clicks_change", "clicks_change_pct", "rank")


@register("an11_an12_visibility_losses", g.with_(*QREC, vis_sql("query")) +
          "SELECT property_id, query, impressions_change, previous_impressions, loss_kind, rank FROM vis")
def an11_an12_visibility_losses(spark, sf):
    return lists(web_only(spark, sf), "query")[0]["visibility"].select(
        "property_id", "query", "impressions_change", "previous_impressions", "loss_kind", "rank")


@register("an12_loss_kinds", g.with_(*FIG, *records_sql("page")) + f"SELECT property_id, page, {KIND} AS loss_kind FROM rec")
def an12_loss_kinds(spark, sf):
    return search.with_loss_kind(search.records(web_only(spark, sf), ["page"])).select("property_id", "page", "loss_kind")


for _dir in ("loss", "gain"):
    def _conc(spark, sf, d=_dir):
        return search.concentration(search.records(web_only(spark, sf), ["query"]), "query", d).withColumn(
            "entities", F.array_join("entities", ","))
    register(f"an13_win4_{_dir}_concentration", g.with_(*QREC, conc_sql("query", _dir)) +
             "SELECT property_id, total_change, top_n_change, top_n, entities, top_n_share_pct FROM conc")(_conc)


@register("s4_top_queries", g.with_(*QREC) + """
SELECT property_id, query, 'clicks' AS ranked_by, clicks AS figure, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY coalesce(clicks, 0) DESC, query) AS rank FROM rec) WHERE rank <= 15
UNION ALL SELECT property_id, query, 'impressions', impressions, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY coalesce(impressions, 0) DESC, query) AS rank FROM rec) WHERE rank <= 15""")
def s4_top_queries(spark, sf):
    recs = search.records(web_only(spark, sf), ["query"])
    parts = [search.top_rows(recs, "query", by).select("property_id", "query", F.lit(by).alias("ranked_by"),
                                                       F.col(by).alias("figure"), "rank") for by in ("clicks", "impressions")]
    return parts[0].unionByName(parts[1])


@register("a14_reconciliation", g.with_(*FIG, *records_sql("appearance")) + f"""
SELECT property_id, sum(clicks) AS dimension_clicks, sum(impressions) AS dimension_impressions, count(*) AS rows,
  any_value(p_clicks) AS property_clicks, any_value(p_impressions) AS property_impressions,
  {g.rnd('sum(clicks) / nullif(any_value(p_clicks), 0) * 100.0', 1)} AS coverage_pct
FROM rec JOIN fig USING (property_id) WHERE present_in <> 'previous only' GROUP BY property_id""")
def a14_reconciliation(spark, sf):
    sides = search.two_sided(web_only(spark, sf), ["property_id", "appearance"])
    return search.reconciliation(search.clean(sides, ["appearance"]), search.totals_of(sides))


SHARES = """shares AS (SELECT *, CASE WHEN clicks <> 0 THEN {c} END AS share_of_clicks_pct,
    CASE WHEN impressions <> 0 THEN {i} END AS share_of_impressions_pct
  FROM (SELECT *, sum(coalesce(clicks, 0)) OVER (PARTITION BY property_id) AS wc,
    sum(coalesce(impressions, 0)) OVER (PARTITION BY property_id) AS wi FROM rec))""".format(
    c=g.rnd("clicks / nullif(wc, 0) * 100.0", 1), i=g.rnd("impressions / nullif(wi, 0) * 100.0", 1))


@register("an15_f8_win3_devices", g.with_(*FIG, *records_sql("device"), SHARES) + """
SELECT property_id, device, clicks, share_of_clicks_pct, share_of_impressions_pct,
  coalesce(share_of_clicks_pct < 3, false) AS negligible FROM shares""")
def an15_f8_win3_devices(spark, sf):
    return search.devices(search.records(web_only(spark, sf), ["device"])).select(
        "property_id", "device", "clicks", "share_of_clicks_pct", "share_of_impressions_pct", "negligible")


COUNTRIES = """ctry0 AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY coalesce(clicks, 0) DESC, country) AS rank FROM shares),
ctry1 AS (SELECT *, max(CASE WHEN rank = 1 THEN share_of_clicks_pct END) OVER (PARTITION BY property_id) AS top_share,
  count(*) FILTER (coalesce(share_of_clicks_pct, 0) >= 5) OVER (PARTITION BY property_id) AS big,
  coalesce(rank <= 10 AND abs(clicks_change) >= greatest(10.0, wc * 0.02), false) AS mover FROM ctry0),
ctry AS (SELECT *, (top_share IS NULL OR top_share < 85 OR big > 1) OR bool_or(mover) OVER (PARTITION BY property_id) AS material FROM ctry1)"""


@register("an16_countries", g.with_(*FIG, *records_sql("country"), SHARES, COUNTRIES) +
          "SELECT property_id, country, clicks, share_of_clicks_pct, rank, top_share, mover, material FROM ctry")
def an16_countries(spark, sf):
    return search.countries(search.records(web_only(spark, sf), ["country"])).select(
        "property_id", "country", "clicks", "share_of_clicks_pct", "rank", "top_share", "mover", "material")


@register("an17_appearance", g.with_(*FIG, *records_sql("appearance")) + """
SELECT property_id, appearance, impressions, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
  ORDER BY coalesce(impressions, 0) DESC, appearance) AS rank FROM rec) WHERE rank <= 15""")
def an17_appearance(spark, sf):
    return search.top_rows(search.records(web_only(spark, sf), ["appearance"]), "appearance", "impressions").select(
        "property_id", "appearance", "impressions", "rank")


PAIRS = """qp AS (SELECT property_id, query, page, sum(clicks) AS clicks, sum(impressions) AS impressions FROM sw
  WHERE in_current GROUP BY 1, 2, 3)"""


@register("win1_j7_query_owner", g.with_(SEARCH_SQL, WEBROWS, PAIRS) + """
SELECT property_id, query, page, impressions::DOUBLE AS impressions FROM (SELECT *, row_number() OVER (PARTITION BY property_id, query
  ORDER BY impressions DESC NULLS LAST, page) AS rn FROM qp) WHERE rn = 1""")
def win1_j7_query_owner(spark, sf):
    return search.owners(web_only(spark, sf)).withColumn("impressions", F.col("impressions").cast("double"))


CANNIBAL = f"""cann AS (SELECT property_id, query, pages, total_impressions, {g.rnd('share * 100.0', 1)} AS second_page_share_pct, top_pages,
    row_number() OVER (PARTITION BY property_id ORDER BY total_impressions DESC, query) AS rank
  FROM (SELECT property_id, query, count(*) AS pages, sum(impressions)::DOUBLE AS total_impressions,
      coalesce(max(CASE WHEN rn = 2 THEN impressions END)::DOUBLE / nullif(sum(impressions)::DOUBLE, 0), 0) AS share,
      string_agg(page, ' ' ORDER BY rn) FILTER (rn <= 4) AS top_pages
    FROM (SELECT *, row_number() OVER (PARTITION BY property_id, query ORDER BY coalesce(impressions, 0) DESC, page) AS rn FROM qp)
    GROUP BY 1, 2) JOIN fig USING (property_id)
  WHERE pages >= 2 AND share >= 0.2 AND total_impressions >= greatest(200.0, floor) QUALIFY rank <= 10)"""


@register("an14_win2_cannibalisation", g.with_(*FIG, PAIRS, CANNIBAL) +
          "SELECT property_id, query, pages, total_impressions, second_page_share_pct, top_pages, rank FROM cann")
def an14_win2_cannibalisation(spark, sf):
    rows = stage(search.rollup(web_only(spark, sf), ["query", "page"]), "query-pages")
    c = search.cannibalisation(search.query_pages(rows), search.property_figures(totals(rows)))
    return c.select("property_id", "query", F.col("pages"), F.col("total_impressions").cast("double").alias("total_impressions"),
                    "second_page_share_pct", F.array_join(F.transform("top_pages", lambda p: p["page"]), " ").alias("top_pages"), "rank")


@register("a15_f2_brand_split", g.with_(*FIG, *records_sql("query"), f"""
terms AS (SELECT r_name AS property_id, CASE WHEN r_regionkey = 0 THEN [] ELSE ['1' || r_regionkey, 'P7'] END AS terms FROM region),
lab AS (SELECT rec.*, CASE WHEN len(list_filter(terms, lambda t: contains(lower(query), lower(t)))) > 0 THEN 'branded'
  ELSE 'non-branded' END AS label FROM rec JOIN terms USING (property_id) WHERE len(terms) > 0),
sides AS (SELECT property_id, label, count(*) AS queries, sum(coalesce(clicks, 0)) AS clicks, sum(coalesce(impressions, 0)) AS impressions,
  sum(coalesce(previous_clicks, 0)) AS previous_clicks, sum(coalesce(previous_impressions, 0)) AS previous_impressions FROM lab GROUP BY 1, 2)""") + f"""
SELECT *, {g.rnd('clicks / nullif(impressions, 0) * 100.0', 2)} AS ctr, clicks - previous_clicks AS clicks_change,
  {g.rnd('(clicks - previous_clicks) / nullif(abs(previous_clicks), 0) * 100.0', 1)} AS clicks_change_pct,
  {g.rnd('clicks / nullif(sum(clicks) OVER (PARTITION BY property_id), 0) * 100.0', 1)} AS share_of_clicks_pct FROM sides""")
def a15_f2_brand_split(spark, sf):
    settings = table(spark, sf, "region").selectExpr(
        "r_name AS property_id", "IF(r_regionkey = 0, CAST(array() AS ARRAY<STRING>), array('1' || r_regionkey, 'P7')) AS brand_terms")
    return search.brand_split(search.records(web_only(spark, sf), ["query"]), settings)


DECOMP_KPI = KPIS + [
    """w AS (SELECT property_id, max(CASE WHEN key = 'clicks' THEN absolute_change END) AS actual,
      max(CASE WHEN key = 'impressions' THEN absolute_change END) AS d_imp, max(CASE WHEN key = 'impressions' THEN cur4 END) AS imp_now,
      max(CASE WHEN key = 'ctr' THEN absolute_change END) AS d_ctr, max(CASE WHEN key = 'ctr' THEN prev4 END) AS ctr_prev,
      bool_or(key = 'clicks' AND material) AS material FROM chg GROUP BY 1)""",
    """dec0 AS (SELECT property_id, material, actual, d_imp * (ctr_prev / 100.0) AS fi, imp_now * (d_ctr / 100.0) AS fc FROM w
      WHERE actual IS NOT NULL AND d_imp IS NOT NULL AND d_ctr IS NOT NULL)""",
    f"""dec AS (SELECT property_id, material, {g.rnd('actual')} AS actual_click_change, {g.rnd('fi')} AS explained_by_impressions,
      {g.rnd('fc')} AS explained_by_ctr, {g.rnd('actual - (fi + fc)')} AS interaction_residual,
      CASE WHEN abs(fi) + abs(fc) = 0 THEN 'neither' WHEN abs(fi) >= abs(fc) * 1.5 THEN 'impressions'
        WHEN abs(fc) >= abs(fi) * 1.5 THEN 'ctr' ELSE 'both' END AS dominant_factor FROM dec0)"""]


@register("an6_click_decomposition", g.with_(*DECOMP_KPI) + "SELECT * FROM dec")
def an6_click_decomposition(spark, sf):
    return search.decompose_clicks(search.kpis_wide(totals(web_only(spark, sf))))


@register("an19_j13_inspection_targets", g.with_(*FIG, *records_sql("query")) + """
SELECT property_id, page, previous_impressions, lost, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY score DESC, page) AS rank
  FROM (SELECT property_id, query AS page, previous_impressions, previous_impressions - coalesce(impressions, 0) AS lost,
    CASE WHEN coalesce(impressions, 0) = 0 THEN (previous_impressions - coalesce(impressions, 0)) * 2
      WHEN (previous_impressions - coalesce(impressions, 0)) / previous_impressions >= 0.6 AND previous_impressions - coalesce(impressions, 0) >= 200
      THEN previous_impressions - coalesce(impressions, 0) END AS score FROM rec WHERE previous_impressions >= 100) WHERE score IS NOT NULL)
WHERE rank <= 10""")
def an19_j13_inspection_targets(spark, sf):
    recs = search.records(web_only(spark, sf), ["query"]).withColumnRenamed("query", "page")
    return search.inspection_targets(recs).select("property_id", "page", "previous_impressions", "lost", "score", "rank")


MAP_SQL = f"""pts AS (SELECT property_id, page, clicks, impressions, position, ctr, rank FROM (SELECT *, row_number() OVER (PARTITION BY property_id
    ORDER BY coalesce(impressions, 0) DESC, page) AS rank FROM rec) WHERE rank <= 15 AND impressions > 0 AND position IS NOT NULL)"""


@register("an30_page_scatter", g.with_(*FIG, *records_sql("page"), MAP_SQL) + """
SELECT property_id, page, clicks, impressions, position, coalesce(ctr, 0) >= med AS at_or_above_median, rank FROM pts JOIN
  (SELECT property_id, max(CASE WHEN rn = n // 2 + 1 THEN c END) AS med FROM (SELECT property_id, coalesce(ctr, 0) AS c,
    row_number() OVER (PARTITION BY property_id ORDER BY coalesce(ctr, 0)) AS rn, count(*) OVER (PARTITION BY property_id) AS n FROM pts)
   GROUP BY 1) USING (property_id)""")
def an30_page_scatter(spark, sf):
    return search.page_scatter(search.records(web_only(spark, sf), ["page"]))


# --- daily ----------------------------------------------------------------------------------

DAILY = ["""daily AS (SELECT property_id, date, sum(clicks)::DOUBLE AS clicks, sum(impressions)::DOUBLE AS impressions
  FROM sw WHERE in_current GROUP BY 1, 2)"""]


def daily(spark, sf):
    return web_only(spark, sf).filter("in_current").groupBy("property_id", "date").agg(
        F.sum("clicks").cast("double").alias("clicks"), F.sum("impressions").cast("double").alias("impressions"))


ANOM = [
    """ser AS (SELECT property_id, date, 'clicks' AS metric, clicks AS value FROM daily UNION ALL SELECT property_id, date, 'impressions', impressions FROM daily)""",
    """cen AS (SELECT *, abs(value - median) AS dev FROM (SELECT *, CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_kind,
      median(value) OVER (PARTITION BY property_id, metric, isodow(date) >= 6) AS median,
      count(*) OVER (PARTITION BY property_id, metric, isodow(date) >= 6) AS n FROM ser))""",
    f"""anom AS (SELECT property_id, CAST(date AS VARCHAR) AS date, metric, value, day_kind, {g.rnd('median')} AS typical, {g.rnd('value - median')} AS deviation,
      {g.rnd('(value - median) / median * 100.0', 1)} AS deviation_pct, CASE WHEN value > median THEN 'spike' ELSE 'drop' END AS kind,
      CASE WHEN count(*) OVER (PARTITION BY property_id, date) > 1 THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT *, median(dev) OVER (PARTITION BY property_id, metric, day_kind) AS mad FROM cen)
    WHERE n >= 6 AND median <> 0 AND mad <> 0 AND dev >= 4 * mad
      AND dev >= greatest(CASE WHEN metric = 'clicks' THEN 10.0 ELSE 100.0 END, median * 0.3))""",
]


@register("an2_win7_win10_search_anomalies", g.with_(SEARCH_SQL, WEBROWS, *DAILY, *ANOM) + "SELECT * FROM anom")
def an2_win7_win10_search_anomalies(spark, sf):
    return timeseries.search_anomalies(daily(spark, sf)).withColumn("date", F.col("date").cast("string"))


SHAPE = f"""shp AS (SELECT property_id, first_half, second_half, {g.rnd('raw', 1)} AS change_pct,
    CASE WHEN abs(raw) < 10 THEN 'stable' WHEN raw > 0 THEN 'rising' ELSE 'falling' END AS trend
  FROM (SELECT *, (second_half - first_half) / nullif(abs(first_half), 0) * 100.0 AS raw FROM (
    SELECT property_id, sum(clicks) FILTER (rn <= n // 2) AS first_half, sum(clicks) FILTER (rn > n - n // 2) AS second_half
    FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY property_id) AS n FROM daily)
    WHERE n >= 14 GROUP BY 1)) WHERE raw IS NOT NULL)"""


@register("an5_period_shape", g.with_(SEARCH_SQL, WEBROWS, *DAILY, SHAPE) + "SELECT * FROM shp")
def an5_period_shape(spark, sf):
    return timeseries.shape(daily(spark, sf))


@register("w5_freshness", g.with_(SEARCH_SQL) + """
SELECT property_id, CAST(max(date) FILTER (state = 'final') AS VARCHAR) AS latest_final, CAST(max(date) AS VARCHAR) AS latest_any,
  count(DISTINCT date) FILTER (state = 'final') AS days_with_final,
  date_diff('day', max(date) FILTER (state = 'final'), DATE '1999-07-15') AS lag_days,
  greatest(date_diff('day', max(date) FILTER (state = 'final'), max(date)), 0) AS fresh_days
FROM search WHERE date BETWEEN DATE '1999-07-01' AND DATE '1999-07-15' GROUP BY property_id""")
def w5_freshness(spark, sf):
    today = F.lit("1999-07-15").cast("date")
    f = periods.freshness(search_stats(spark, sf), today)
    return f.withColumns({c: F.col(c).cast("string") for c in ("latest_final", "latest_any")})


# --- findings -------------------------------------------------------------------------------

OUT = ["property_id", "id", "type", "severity", "confidence", "scope", "entity", "detail"]
_BASE = "CASE WHEN coalesce(clicks_cur, 0) < 30 THEN 'low' ELSE 'high' END"
_NEW = " AND ".join(f"({k.key}_cur IS NULL OR {k.key}_verdict = 'new')" for k in SEARCH_KPIS)
_FLAT = " AND ".join(f"NOT {k.key}_material" for k in SEARCH_KPIS)
KW = """kw AS (SELECT property_id, {cols} FROM chg GROUP BY property_id)""".format(cols=", ".join(
    f"max(CASE WHEN key = '{k.key}' THEN {c} END) AS {k.key}_{n}" for k in SEARCH_KPIS
    for n, c in (("cur", "cur4"), ("pct", "percent_change"), ("verdict", "verdict"), ("material", "material"), ("avail", "availability"))))
_RULES = [
    ("clicks_verdict = 'improved'", "clicks_up", "traffic", "'high'", _BASE, "strengths"),
    ("clicks_verdict = 'declined'", "clicks_down", "traffic", "'high'", _BASE, "weaknesses"),
    ("impressions_verdict = 'improved' AND clicks_verdict <> 'improved'", "impressions_up_clicks_flat", "visibility", "'medium'", _BASE, "observations"),
    ("clicks_verdict = 'declined' AND clicks_pct < impressions_pct - 5", "clicks_falling_faster", "ctr", "'high'", _BASE, "weaknesses"),
    ("ctr_verdict = 'declined' AND average_position_avail = 'available' AND NOT average_position_material", "ctr_down_position_stable", "ctr", "'high'", _BASE, "weaknesses"),
    ("ctr_verdict = 'improved' AND clicks_verdict <> 'declined'", "ctr_up", "ctr", "'medium'", _BASE, "strengths"),
    ("average_position_verdict = 'improved'", "position_improved", "ranking", "'medium'", "'medium'", "strengths"),
    ("average_position_verdict = 'improved' AND clicks_verdict = 'declined'", "position_up_clicks_down", "ranking", "'medium'", "'medium'", "observations"),
    ("average_position_verdict = 'declined'", "position_declined", "ranking", "'medium'", "'medium'", "weaknesses"),
    (_NEW, "no_baseline", "coverage", "'medium'", "'high'", "observations"),
    (f"NOT ({_NEW}) AND {_FLAT}", "broadly_flat", "trend", "'low'", _BASE, "observations"),
    ("clicks_material AND dominant_factor IS NOT NULL", "click_attribution", "attribution", "'low'", "'high'", "observations"),
    ("trend = 'falling' AND abs(change_pct) >= 20", "declining_within_period", "trend", "'high'", "'medium'", "risks"),
    ("trend = 'rising' AND change_pct >= 20", "rising_within_period", "trend", "'medium'", "'medium'", "strengths"),
]
KPI_F = "kpi_f AS (" + "\n UNION ALL ".join(
    f"SELECT property_id, '{i}' AS id, '{t}' AS type, {s} AS severity, {c} AS confidence, 'property' AS scope, NULL AS entity, '{d}' AS detail FROM kj WHERE {cond}"
    for cond, i, t, s, c, d in _RULES) + ")"
KJ = "kj AS (SELECT * FROM kw LEFT JOIN dec USING (property_id) LEFT JOIN shp USING (property_id))"


def kpi_part(rows, day):
    kpis = search.kpis_wide(totals(rows))
    return search_findings.kpi_findings(kpis, search.decompose_clicks(kpis), timeseries.shape(day))


@register("fs01_fs08_kpi_findings", g.with_(*DECOMP_KPI, *DAILY, SHAPE, KW, KJ, KPI_F) + "SELECT * FROM kpi_f")
def fs01_fs08_kpi_findings(spark, sf):
    return kpi_part(web_only(spark, sf), daily(spark, sf)).select(*OUT)


@register("fs09_anomaly_findings", g.with_(SEARCH_SQL, WEBROWS, *DAILY, *ANOM) + """
SELECT property_id, 'anomaly:' || date || ':' || metric AS id, 'anomaly' AS type, CASE WHEN kind = 'spike' THEN 'low' ELSE 'medium' END AS severity,
  confidence, 'day' AS scope, date AS entity, 'anomalies' AS detail
FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY date, metric) AS rn FROM anom) WHERE rn <= 6""")
def fs09_anomaly_findings(spark, sf):
    return search_findings.anomaly_findings(timeseries.search_anomalies(daily(spark, sf))).select(*OUT)


def _dim_findings_sql(key):
    def one(src, i, t, sev, conf, det):
        return (f"SELECT property_id, '{key}_{i}' AS id, '{t}' AS type, {sev} AS severity, '{conf}' AS confidence, '{key}' AS scope, "
                f"NULL AS entity, '{det}' AS detail FROM {src} GROUP BY property_id")
    return [movers_sql(key, "loss", "los"), movers_sql(key, "gain", "win"), conc_sql(key, "loss"), vis_sql(key), BENCH,
            ctr_ops_sql(key), rank_ops_sql(key)], " UNION ALL ".join([
                one("los", "losses", "traffic", "CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END", "high", "weaknesses"),
                one("win", "gains", "traffic", "'medium'", "high", "strengths"),
                one("(SELECT * FROM conc WHERE top_n_share_pct >= 60)", "loss_concentration", "concentration", "'medium'", "high", "risks"),
                one("vis", "visibility_losses", "visibility", "'medium'", "medium", "risks"),
                one("ctr_ops", "ctr_opportunities", "ctr", "'medium'", "medium", "opportunities"),
                one("rank_ops", "ranking_opportunities", "ranking", "'medium'", "medium", "opportunities")])


for _key in ("query", "page"):
    _ctes, _sel = _dim_findings_sql(_key)

    def _dim(spark, sf, key=_key):
        found, conc = lists(web_only(spark, sf), key)
        return search_findings.dimension_findings(key, found, conc).select(*OUT)
    register(f"fs10_fs14_{_key}_findings", g.with_(*FIG, *records_sql(_key), *_ctes) + _sel)(_dim)


@register("fs15_device_findings", g.with_(*FIG, *records_sql("device")) + """
SELECT property_id, 'device_ctr_decline:' || device AS id, 'ctr' AS type, 'medium' AS severity, 'medium' AS confidence, 'device' AS scope,
  device AS entity, 'weaknesses' AS detail FROM rec WHERE impressions >= 1000 AND ctr_change_points <= -0.4 AND device <> ''""")
def fs15_device_findings(spark, sf):
    return search_findings.device_findings(search.devices(search.records(web_only(spark, sf), ["device"]))).select(*OUT)


@register("fs16_country_findings", g.with_(*KPIS, *records_sql("country"), SHARES, COUNTRIES) + """
SELECT property_id, 'country_move:' || country AS id, 'geography' AS type, 'low' AS severity, 'medium' AS confidence, 'country' AS scope,
  country AS entity, 'observations' AS detail FROM (SELECT c.*, row_number() OVER (PARTITION BY c.property_id ORDER BY rank) AS n
  FROM ctry c JOIN chg k ON k.property_id = c.property_id AND k.key = 'clicks'
  WHERE c.material AND rank <= 15 AND abs(clicks_change) >= 50 AND share_of_clicks_pct >= 5
    AND (k.percent_change IS NULL OR clicks_change_pct IS NULL OR abs(clicks_change_pct - k.percent_change) >= 15)) WHERE n <= 3""")
def fs16_country_findings(spark, sf):
    rows = web_only(spark, sf)
    return search_findings.country_findings(
        search.countries(search.records(rows, ["country"])), search.kpis_wide(totals(rows))).select(*OUT)


@register("fs17_cannibal_findings", g.with_(*FIG, PAIRS, CANNIBAL) + """
SELECT property_id, 'cannibalisation:' || query AS id, 'cannibalisation' AS type, 'low' AS severity, 'low' AS confidence, 'query' AS scope,
  query AS entity, 'observations' AS detail FROM cann WHERE rank <= 3""")
def fs17_cannibal_findings(spark, sf):
    rows = stage(search.rollup(web_only(spark, sf), ["query", "page"]), "query-pages")
    c = search.cannibalisation(search.query_pages(rows), search.property_figures(totals(rows)))
    return search_findings.cannibal_findings(c).select(*OUT)


FS19 = f"""CASE WHEN clicks_change < 0 AND {KIND} = 'ranking' THEN 'position moved from ' || format('{{:.1f}}', previous_position) || ' to ' || format('{{:.1f}}', position)
  WHEN clicks_change < 0 AND {KIND} = 'visibility' THEN 'impressions fell ' || CASE WHEN impressions_change_pct IS NULL THEN 'n/a' ELSE
    CASE WHEN impressions_change_pct > 0 THEN '+' ELSE '' END || format('{{:.1f}}%', impressions_change_pct) END
  WHEN clicks_change < 0 AND {KIND} = 'ctr' THEN 'CTR fell ' || format('{{:.2f}} pp', ctr_change_points)
  WHEN clicks_change > 0 AND position_change < -0.3 THEN 'position improved from ' || format('{{:.1f}}', previous_position) || ' to ' || format('{{:.1f}}', position)
  WHEN clicks_change > 0 AND impressions_change > 0 THEN 'impressions rose ' || CASE WHEN impressions_change_pct IS NULL THEN 'n/a' ELSE
    CASE WHEN impressions_change_pct > 0 THEN '+' ELSE '' END || format('{{:.1f}}%', impressions_change_pct) END
  ELSE 'impressions ' || CASE WHEN impressions_change IS NULL THEN 'n/a' ELSE CASE WHEN impressions_change > 0 THEN '+' ELSE '' END || format('{{:,.0f}}', impressions_change) END
    || ', position ' || CASE WHEN position_change IS NULL THEN 'n/a' ELSE CASE WHEN position_change > 0 THEN '+' ELSE '' END || format('{{:.1f}}', position_change) END END"""


@register("fs19_row_change", g.with_(*FIG, *records_sql("page")) + f"SELECT property_id, page, {FS19} AS row_change FROM rec")
def fs19_row_change(spark, sf):
    return search_findings.with_row_change(search.records(web_only(spark, sf), ["page"])).select(
        "property_id", "page", "row_change")


PREC = [c.replace("rec0", "prec0").replace("rec AS", "prec AS") for c in records_sql("page")]
PBENCH = BENCH.replace("bench AS", "pbench AS").replace("FROM rec ", "FROM prec ")
R3 = [
    ctr_ops_sql("query"), rank_ops_sql("query"),
    ctr_ops_sql("page", "pctr", "prec").replace("bench USING", "pbench USING"), movers_sql("page", "loss", "plos", "prec"),
    f"""kinds AS (SELECT property_id, kind FROM (SELECT property_id, kind, row_number() OVER (PARTITION BY property_id ORDER BY count(*) DESC, min(rank)) AS rn
      FROM (SELECT property_id, rank, {KIND} AS kind FROM plos WHERE rank <= 5) GROUP BY 1, 2) WHERE rn = 1)""",
    """recs AS (SELECT property_id, 'page_ctr_opportunities' AS from_finding, 'Rewrite title and description of ' || page AS action,
        CASE WHEN NOT ceiling_is_speculative AND clicks_at_band_median >= 50 THEN 'High' ELSE 'Medium' END AS priority,
        CASE WHEN ceiling_is_speculative THEN 'low' ELSE 'medium' END AS confidence, clicks_at_band_median AS amount FROM pctr WHERE rank <= 3
      UNION ALL SELECT property_id, 'query_ctr_opportunities', 'Review the search result shown for ' || query, 'Medium', 'medium', clicks_at_band_median FROM ctr_ops WHERE rank <= 2
      UNION ALL SELECT property_id, 'query_ranking_opportunities', 'Strengthen the page targeting ' || query, 'Medium',
        CASE WHEN band = '11-20' THEN 'low' ELSE 'medium' END, opportunity_score FROM rank_ops WHERE rank <= 3
      UNION ALL SELECT property_id, 'page_losses', 'Work on the ' || any_value(kind) || ' losses, starting with ' || max(CASE WHEN rank = 1 THEN page END),
        'High', 'medium', abs(sum(clicks_change)) FROM plos JOIN kinds USING (property_id) WHERE rank <= 5 GROUP BY property_id
      UNION ALL SELECT property_id, 'ctr_down_position_stable', 'Audit how the top ten pages appear in search results', 'High', 'medium',
        abs(coalesce(impressions_cur, 0) * ctr_abs / 100.0) FROM kj2 WHERE ctr_verdict = 'declined' AND average_position_avail = 'available' AND NOT average_position_material)""",
]
KJ2 = """kj2 AS (SELECT kw.*, x.absolute_change AS ctr_abs FROM kw JOIN chg x ON x.property_id = kw.property_id AND x.key = 'ctr')"""


@register("r3_a22_search_recommendations", g.with_(*FIG[:3], g.unpivot("tot", "property_id", SPECS), g.search_chg("kl"), FIG[3], KW, KJ2,
                                                   *records_sql("query"), *PREC, BENCH, PBENCH, *R3) + """
SELECT property_id, from_finding, action, priority, confidence, amount, row_number() OVER (PARTITION BY property_id
  ORDER BY CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, from_finding, action) AS position FROM recs""")
def r3_a22_search_recommendations(spark, sf):
    rows = web_only(spark, sf)
    queries, _ = lists(rows, "query")
    pages, _ = lists(rows, "page")
    recs = search_findings.recommendations(queries, pages, kpi_part(rows, daily(spark, sf)))
    return recs.select("property_id", "from_finding", "action", "priority", "confidence", "amount", "position")
