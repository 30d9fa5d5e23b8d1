"""Organic-search performance: KPIs, joined dimension records, opportunities and losses.

Facts carry property_id, date, the dimensions, clicks, impressions and position per row. Position
travels as a weighted sum and its weight, so any level can be re-aggregated from a finer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import (
    BENCHMARK_MIN_IMPRESSIONS, BENCHMARK_MIN_ROWS, CANNIBAL_MIN_IMPRESSIONS, CANNIBAL_MIN_SHARE,
    DETAIL_N, OPPORTUNITY_FLOOR, OPPORTUNITY_SHARE, POSITION_BANDS, SEARCH_FLOORS, SEARCH_KPIS,
    TOP_N,
)
from ..functions.compare import Change, search_changes
from ..functions.nulls import rnd, rnd_sql
from ..functions.text import matches_any_term, short_url
from .aggregate import attach, exact_median, top_per, two_period

MEASURES = ["clicks", "impressions", "pos_num", "pos_den"]


def with_position_sums(facts: DataFrame) -> DataFrame:
    """Weighted position as two columns that add up; a roll-up already has them."""
    if "pos_num" in facts.columns:
        return facts
    usable = "position IS NOT NULL AND impressions <> 0"
    return facts.withColumns({
        "pos_num": F.expr(f"CASE WHEN {usable} THEN position * impressions END"),
        "pos_den": F.expr(f"CASE WHEN {usable} THEN impressions END"),
    })


def band_sql(position: str) -> str:
    cases = " ".join(f"WHEN {position} < {upper}D THEN '{name}'" for name, upper in POSITION_BANDS)
    return f"CASE WHEN {position} < 0 THEN NULL {cases} END"


def rollup(facts: DataFrame, dims: list[str]) -> DataFrame:
    """Marked facts summed to `dims` with both flags, ready for every operator below."""
    return with_position_sums(facts).groupBy(
        "property_id", *dims, "in_current", "in_previous"
    ).agg(*[F.sum(m).alias(m) for m in MEASURES])


def reaggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Finer exports summed to `keys`: sums add, CTR and position are recomputed.

    Works on facts and on its own output, because it keeps the position sums.
    """
    sums = rows.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.withColumns({
        "ctr": F.expr("try_divide(CAST(clicks AS DOUBLE), CAST(impressions AS DOUBLE))"),
        "position": F.expr("try_divide(CAST(pos_num AS DOUBLE), CAST(pos_den AS DOUBLE))"),
    })


def two_sided(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Both periods per key with CTR in percent and weighted position, unrounded."""
    measures = {m: F.col(m) for m in MEASURES}
    return _with_rates(two_period(with_position_sums(facts), keys, measures))


def _with_rates(sums: DataFrame) -> DataFrame:
    out = {}
    for p in ("cur_", "prev_"):
        out[p + "ctr"] = F.expr(
            f"try_divide(CAST({p}clicks AS DOUBLE), CAST({p}impressions AS DOUBLE)) * 100.0D")
        out[p + "average_position"] = F.expr(
            f"try_divide(CAST({p}pos_num AS DOUBLE), CAST({p}pos_den AS DOUBLE))")
    return sums.withColumns(out)


def kpis_wide(totals: DataFrame, keys: tuple[str, ...] = ("property_id",)) -> DataFrame:
    items = [
        Change(f"k_{k.key}", f"cur_{k.key}", f"prev_{k.key}", k.unit, k.better,
               SEARCH_FLOORS[k.key])
        for k in SEARCH_KPIS
    ]
    changed = search_changes(totals, items)
    return changed.select(*keys, *[i.out for i in items])


def property_figures(totals: DataFrame) -> DataFrame:
    """Per property: totals, the opportunity floor and the click floor."""
    return totals.select(
        "property_id",
        F.col("cur_clicks").cast("double").alias("p_clicks"),
        F.col("cur_impressions").cast("double").alias("p_impressions"),
        F.expr(f"greatest({OPPORTUNITY_FLOOR}.0D, coalesce("
               f"rint(CAST(cur_impressions AS DOUBLE) * {OPPORTUNITY_SHARE}D), 0.0D))"
               ).alias("floor"),
        F.expr("greatest(10.0D, floor(coalesce(CAST(cur_clicks AS DOUBLE), 0.0D) * 0.005D))"
               ).cast("double").alias("click_floor"),
    )


def totals_of(sides: DataFrame) -> DataFrame:
    """Property totals from the sums of a finer `two_sided` frame; position is weighted again."""
    names = [f"{p}{m}" for p in ("cur_", "prev_") for m in MEASURES]
    sums = sides.groupBy("property_id").agg(*[F.sum(c).alias(c) for c in names])
    return _with_rates(sums)


def records(facts: DataFrame, dims: list[str]) -> DataFrame:
    """`clean` records of a dimension straight from marked facts."""
    return clean(two_sided(facts, ["property_id", *dims]), dims)


def clean(sides: DataFrame, dims: list[str]) -> DataFrame:
    """One row per property and key with both periods, deltas, band and rounding.

    Figures are rounded once here and every later threshold reads the rounded value; only the band
    comes from the unrounded position. A side without rows stays null; null keys drop out.
    """
    raw = sides.filter(" AND ".join(f"{d} IS NOT NULL" for d in dims)).withColumns({
        "c1": F.expr("CAST(cur_clicks AS DOUBLE)"), "c0": F.expr("CAST(prev_clicks AS DOUBLE)"),
        "i1": F.expr("CAST(cur_impressions AS DOUBLE)"),
        "i0": F.expr("CAST(prev_impressions AS DOUBLE)"),
    })
    present = ("CASE WHEN cur_rows > 0 AND prev_rows > 0 THEN 'both' "
               "WHEN cur_rows > 0 THEN 'current only' ELSE 'previous only' END")
    moved = "(cur_average_position - prev_average_position)"
    return raw.selectExpr(
        "property_id", *dims, f"{present} AS present_in",
        f"{rnd_sql('c1', 0)} AS clicks", f"{rnd_sql('i1', 0)} AS impressions",
        f"{rnd_sql('cur_ctr', 2)} AS ctr", f"{rnd_sql('cur_average_position', 1)} AS position",
        f"{rnd_sql('c0', 0)} AS previous_clicks", f"{rnd_sql('i0', 0)} AS previous_impressions",
        f"{rnd_sql('prev_ctr', 2)} AS previous_ctr",
        f"{rnd_sql('prev_average_position', 1)} AS previous_position",
        f"{rnd_sql('(c1 - c0)', 0)} AS clicks_change",
        f"{rnd_sql('try_divide(c1 - c0, abs(c0)) * 100.0D', 1)} AS clicks_change_pct",
        f"{rnd_sql('(i1 - i0)', 0)} AS impressions_change",
        f"{rnd_sql('try_divide(i1 - i0, abs(i0)) * 100.0D', 1)} AS impressions_change_pct",
        f"{rnd_sql('(cur_ctr - prev_ctr)', 2)} AS ctr_change_points",
        f"{rnd_sql(moved, 1)} AS position_change",
        f"CASE WHEN {moved} < 0 THEN 'improved' WHEN {moved} > 0 THEN 'worsened' "
        f"WHEN {moved} = 0 THEN 'flat' END AS position_moved",
        f"{band_sql('cur_average_position')} AS band",
    )


def ctr_benchmarks(recs: DataFrame) -> DataFrame:
    """Median CTR per property and position band from the property's own rows.

    CTR has two decimals, so a band holds at most some ten thousand distinct values however many
    queries stand behind it.
    """
    usable = recs.filter(
        f"impressions >= {BENCHMARK_MIN_IMPRESSIONS} AND ctr IS NOT NULL AND band IS NOT NULL"
    )
    medians = exact_median(usable, ["property_id", "band"], "ctr", "median_ctr", most=None)
    return medians.filter(F.col("rows") >= BENCHMARK_MIN_ROWS).withColumn(
        "median_ctr", rnd(F.col("median_ctr"), 2)
    )


def ctr_opportunities(
    recs: DataFrame, figures: DataFrame, benchmarks: DataFrame, key: str, limit: int = DETAIL_N
) -> DataFrame:
    """Rows with visibility whose CTR trails the property's own median at the same positions."""
    seen = attach(recs.filter("impressions > 0 AND ctr IS NOT NULL AND band IS NOT NULL"),
                  figures.select("property_id", "floor"), ["property_id"], [key], "inner")
    big = seen.filter("impressions >= floor")
    judged = attach(big, benchmarks.select("property_id", "band", "median_ctr"),
                    ["property_id", "band"], [key], "inner")
    gap = (
        judged.filter("median_ctr <> 0 AND ctr < median_ctr * 0.7D")
        .withColumn("potential", F.expr("impressions * (median_ctr - ctr) / 100.0D"))
        .filter("potential >= 5")
        .withColumn("ratio", F.expr("try_divide(potential, clicks)"))
        .withColumns({
            "ctr_gap_points": rnd(F.col("median_ctr") - F.col("ctr"), 2),
            "clicks_at_band_median": rnd(F.col("potential"), 0),
            "ceiling_ratio": rnd(F.col("ratio"), 1),
            "ceiling_is_speculative": F.expr("coalesce(ratio > 3, true)"),
        })
        .drop("potential", "ratio", "floor")
    )
    order = [F.col("clicks_at_band_median").desc(), F.col(key).asc()]
    return top_per(gap, ["property_id"], order, limit)


def ranking_opportunities(
    recs: DataFrame, figures: DataFrame, key: str, limit: int = DETAIL_N
) -> DataFrame:
    """Rows with visibility just below where clicks are: near bands, moving the right way first."""
    near = recs.filter("impressions > 0 AND position IS NOT NULL AND band IN ('4-10', '11-20')")
    big = attach(near, figures.select("property_id", "floor"), ["property_id"], [key], "inner")
    scored = (
        big.filter("impressions >= floor")
        .withColumn("closeness", F.expr("greatest(0.0D, (20.5D - position) / 20.5D)"))
        .withColumn("momentum", F.expr(
            "greatest(-1.0D, least(1.0D, -coalesce(position_change, 0.0D) / 5.0D))"))
        .withColumn("opportunity_score", rnd(F.expr(
            "impressions * (0.6D + 0.4D * closeness) * (1.0D + 0.25D * momentum)"), 0))
        .drop("closeness", "momentum", "floor")
    )
    order = [F.col("opportunity_score").desc(), F.col(key).asc()]
    return top_per(scored, ["property_id"], order, limit)


def click_movers(
    recs: DataFrame, figures: DataFrame, key: str, direction: str, limit: int = DETAIL_N
) -> DataFrame:
    """Biggest click gains or losses over the property's click floor."""
    sign = "clicks_change > 0" if direction == "gain" else "clicks_change < 0"
    sized = attach(recs.filter(sign), figures.select("property_id", "click_floor"),
                   ["property_id"], [key], "inner")
    moved = sized.filter("abs(clicks_change) >= click_floor").drop("click_floor")
    first = F.col("clicks_change").desc() if direction == "gain" else F.col("clicks_change").asc()
    return top_per(moved, ["property_id"], [first, F.col(key).asc()], limit)


LOSS_KIND = (
    "CASE size(loss_kinds) WHEN 0 THEN 'unclear' WHEN 1 THEN loss_kinds[0] ELSE 'mixed' END"
)


def with_loss_kind(recs: DataFrame) -> DataFrame:
    """Name what kind of loss a row is: visibility, ranking, ctr, mixed or unclear."""
    kinds = (
        "array_compact(array("
        f"CASE WHEN impressions_change < 0 AND abs(impressions_change) >= "
        f"greatest({OPPORTUNITY_FLOOR}.0D, coalesce(previous_impressions, 0.0D) * 0.2D) "
        "THEN 'visibility' END, "
        "CASE WHEN position_change > 0.6D THEN 'ranking' END, "
        "CASE WHEN ctr_change_points < -0.2D THEN 'ctr' END))"
    )
    return recs.withColumn("loss_kinds", F.expr(kinds)).withColumn(
        "loss_kind", F.expr(LOSS_KIND)).drop("loss_kinds")


def visibility_losses(
    recs: DataFrame, figures: DataFrame, key: str, limit: int = DETAIL_N
) -> DataFrame:
    """Rows that lost a quarter of their impressions, whether clicks noticed or not."""
    falling = recs.filter(
        "impressions_change < 0 AND previous_impressions > 0 AND abs(impressions_change) >= "
        f"greatest({OPPORTUNITY_FLOOR}.0D, previous_impressions * 0.25D)"
    )
    big = attach(falling, figures.select("property_id", "floor"), ["property_id"], [key], "inner")
    lost = with_loss_kind(big.filter("previous_impressions >= floor").drop("floor"))
    order = [F.col("impressions_change").asc(), F.col(key).asc()]
    return top_per(lost, ["property_id"], order, limit)


def concentration(recs: DataFrame, key: str, direction: str = "loss", limit: int = 5) -> DataFrame:
    """Share of all movement in one direction that the top rows account for."""
    loss = direction == "loss"
    moving = recs.filter("clicks_change < 0" if loss else "clicks_change > 0").select(
        "property_id", key, "clicks_change")
    total = moving.groupBy("property_id").agg(F.sum("clicks_change").alias("total_change"))
    first = F.col("clicks_change").asc() if loss else F.col("clicks_change").desc()
    top = top_per(moving, ["property_id"], [first, F.col(key).asc()], limit)
    sums = top.groupBy("property_id").agg(
        F.sum("clicks_change").alias("top_n_change"),
        F.count("*").alias("top_n"),
        F.transform(F.sort_array(F.collect_list(F.struct("rank", key))),
                    lambda s: s[key]).alias("entities"),
    )
    return sums.join(total, "property_id").withColumn(
        "top_n_share_pct",
        rnd(F.expr("try_divide(abs(top_n_change), abs(total_change)) * 100.0D"), 1),
    )


def top_rows(recs: DataFrame, key: str, by: str, limit: int = TOP_N) -> DataFrame:
    order = [F.coalesce(F.col(by), F.lit(0.0)).desc(), F.col(key).asc()]
    return top_per(recs, ["property_id"], order, limit)


def reconciliation(recs: DataFrame, totals: DataFrame) -> DataFrame:
    """How much of the property's clicks the dimension rows cover; the two are kept apart."""
    dims = recs.filter("present_in <> 'previous only'").groupBy("property_id").agg(
        F.sum("clicks").alias("dimension_clicks"),
        F.sum("impressions").alias("dimension_impressions"), F.count("*").alias("rows"),
    )
    return dims.join(totals.selectExpr(
        "property_id", "CAST(cur_clicks AS DOUBLE) AS property_clicks",
        "CAST(cur_impressions AS DOUBLE) AS property_impressions"), "property_id").withColumn(
        "coverage_pct", rnd(F.expr("try_divide(dimension_clicks, property_clicks) * 100.0D"), 1))


def with_shares(recs: DataFrame, columns: tuple[str, ...] = ("clicks", "impressions")) -> DataFrame:
    """Share of the property total for short dimensions (devices, countries).

    A property has a few devices and at most a few hundred countries, which bounds the window.
    """
    w = Window.partitionBy("property_id")
    out = {}
    for c in columns:
        whole = F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(w)
        out[f"share_of_{c}_pct"] = F.when(
            F.col(c) != 0, rnd(F.try_divide(F.col(c), whole) * F.lit(100.0), 1))
    return recs.withColumns(out)


def devices(recs: DataFrame) -> DataFrame:
    return with_shares(recs).withColumn(
        "negligible", F.coalesce(F.col("share_of_clicks_pct") < 3, F.lit(False)))


def countries(recs: DataFrame) -> DataFrame:
    """Countries by clicks with the property's own verdict on whether geography matters."""
    shared = with_shares(recs, ("clicks",))
    w = Window.partitionBy("property_id")
    ranked = shared.withColumns({
        "rank": F.row_number().over(w.orderBy(F.coalesce("clicks", F.lit(0.0)).desc(),
                                              F.col("country").asc())),
        "total_clicks": F.sum(F.coalesce("clicks", F.lit(0.0))).over(w),
    })
    return ranked.withColumns({
        "top_share": F.max(F.when(F.col("rank") == 1, F.col("share_of_clicks_pct"))).over(w),
        "big": F.count_if(F.coalesce("share_of_clicks_pct", F.lit(0.0)) >= 5).over(w),
        "mover": F.expr("coalesce(rank <= 10 AND abs(clicks_change) >= "
                        "greatest(10.0D, total_clicks * 0.02D), false)"),
    }).withColumn(
        "material",
        F.expr("top_share IS NULL OR top_share < 85 OR big > 1") | F.max("mover").over(w),
    )


def owners(facts: DataFrame) -> DataFrame:
    """The page with most impressions for each query, current period."""
    pairs = with_position_sums(facts.filter("in_current AND query IS NOT NULL")).groupBy(
        "property_id", "query", "page").agg(F.sum("impressions").alias("impressions"))
    order = [F.col("impressions").desc_nulls_last(), F.col("page").asc()]
    return top_per(pairs, ["property_id", "query"], order, 1).drop("rank")


def query_pages(facts: DataFrame) -> DataFrame:
    """Current-period rows per query and page."""
    present = facts.filter("in_current AND query IS NOT NULL AND page IS NOT NULL")
    return reaggregate(with_position_sums(present), ["property_id", "query", "page"])


def cannibalisation(pairs: DataFrame, figures: DataFrame, limit: int = DETAIL_N) -> DataFrame:
    """Queries for which a second page holds a real share of the impressions.

    Counts and sums come from a hash aggregation and the listed pages from a ranked limit, so a
    query with very many pages is never gathered in one place.
    """
    per_query = pairs.groupBy("property_id", "query").agg(
        F.count("*").alias("pages"), F.sum("impressions").alias("total_impressions"))
    order = [F.coalesce("impressions", F.lit(0)).desc(), F.col("page").asc()]
    listed = top_per(pairs, ["property_id", "query"], order, 4).groupBy(
        "property_id", "query").agg(
        F.max(F.when(F.col("rank") == 2, F.col("impressions"))).alias("second_impressions"),
        F.sort_array(F.collect_list(F.struct(
            "rank", "page", short_url(F.col("page")).alias("path"), "clicks", "impressions",
            rnd(F.col("ctr") * 100.0, 2).alias("ctr"), rnd(F.col("position"), 1).alias("position"),
        ))).alias("top_pages"),
    )
    joined = per_query.filter("pages >= 2").join(listed, ["property_id", "query"]).withColumn(
        "share", F.expr("coalesce(try_divide(CAST(second_impressions AS DOUBLE), "
                        "CAST(total_impressions AS DOUBLE)), 0.0D)")
    ).filter(f"share >= {CANNIBAL_MIN_SHARE}D")
    sized = attach(joined, figures.select("property_id", "floor"), ["property_id"], ["query"],
                   "inner").filter(
        f"total_impressions >= greatest({CANNIBAL_MIN_IMPRESSIONS}.0D, floor)").drop("floor")
    ranked = top_per(sized, ["property_id"],
                     [F.col("total_impressions").desc(), F.col("query").asc()], limit)
    return ranked.withColumn("second_page_share_pct", rnd(F.col("share") * 100.0, 1)).drop("share")


def brand_split(recs: DataFrame, settings: DataFrame) -> DataFrame:
    """Branded against other queries, only for properties with configured terms.

    `settings` has property_id and an array `brand_terms`. Without terms there is no row: nothing
    is guessed from the query text.
    """
    configured = settings.filter("size(brand_terms) > 0")
    labelled = attach(recs, configured, ["property_id"], ["query"], "inner").withColumn(
        "label", F.when(matches_any_term(F.col("query"), F.col("brand_terms")), "branded")
        .otherwise("non-branded"))
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)))
    sides = labelled.groupBy("property_id", "label").agg(
        F.count("*").alias("queries"), zero("clicks").alias("clicks"),
        zero("impressions").alias("impressions"), zero("previous_clicks").alias("previous_clicks"),
        zero("previous_impressions").alias("previous_impressions"),
    )
    whole = F.sum("clicks").over(Window.partitionBy("property_id"))
    return sides.withColumns({
        "ctr": rnd(F.expr("try_divide(clicks, impressions) * 100.0D"), 2),
        "clicks_change": F.expr("clicks - previous_clicks"),
        "clicks_change_pct": rnd(F.expr(
            "try_divide(clicks - previous_clicks, abs(previous_clicks)) * 100.0D"), 1),
        "share_of_clicks_pct": rnd(F.try_divide(F.col("clicks"), whole) * 100.0, 1),
    })


def decompose_clicks(kpis: DataFrame) -> DataFrame:
    """Split the click change into an impressions part, a CTR part and the residual."""
    ready = kpis.filter(
        "k_clicks.availability = 'available' AND k_impressions.availability = 'available' "
        "AND k_ctr.availability = 'available'")
    parts = ready.selectExpr(
        "property_id", "k_clicks.absolute_change AS actual", "k_clicks.material AS material",
        "k_impressions.absolute_change * (k_ctr.previous / 100.0D) AS from_impressions",
        "k_impressions.current * (k_ctr.absolute_change / 100.0D) AS from_ctr",
    )
    return parts.selectExpr(
        "property_id", "material",
        f"{rnd_sql('actual', 0)} AS actual_click_change",
        f"{rnd_sql('from_impressions', 0)} AS explained_by_impressions",
        f"{rnd_sql('from_ctr', 0)} AS explained_by_ctr",
        f"{rnd_sql('(actual - (from_impressions + from_ctr))', 0)} AS interaction_residual",
        "CASE WHEN abs(from_impressions) + abs(from_ctr) = 0 THEN 'neither' "
        "WHEN abs(from_impressions) >= abs(from_ctr) * 1.5D THEN 'impressions' "
        "WHEN abs(from_ctr) >= abs(from_impressions) * 1.5D THEN 'ctr' "
        "ELSE 'both' END AS dominant_factor",
    )


def inspection_targets(pages: DataFrame, limit: int = DETAIL_N) -> DataFrame:
    """Pages whose loss of impressions justifies a look at their index status.

    `pages` are the records of the page dimension.
    """
    before, now = "coalesce(previous_impressions, 0.0D)", "coalesce(impressions, 0.0D)"
    scored = pages.filter(f"{before} >= 100").withColumn("lost", F.expr(f"{before} - {now}"))
    scored = scored.withColumn("score", F.expr(
        f"CASE WHEN {now} = 0 THEN lost * 2 "
        f"WHEN lost / {before} >= 0.6D AND lost >= 200 THEN lost END"
    )).filter("score IS NOT NULL")
    order = [F.col("score").desc(), F.col("page").asc()]
    return top_per(scored, ["property_id"], order, limit)


def sitemap_problems(sitemaps: DataFrame) -> DataFrame:
    """One row per problem of a sitemap listing."""
    return sitemaps.selectExpr(
        "property_id", "path",
        "explode(array_compact(array("
        "CASE WHEN errors > 0 THEN 'reports errors' END, "
        "CASE WHEN is_pending THEN 'pending' END, "
        "CASE WHEN last_downloaded IS NULL AND NOT coalesce(is_pending, false) "
        "THEN 'never downloaded' END, "
        "CASE WHEN submitted > 0 AND indexed / submitted < 0.5 THEN 'half or more not indexed' END"
        "))) AS problem",
    )


def dominant_loss_kind(losers: DataFrame, top: int = 5) -> DataFrame:
    """The most common loss kind among the top losers of each property."""
    kinds = with_loss_kind(losers.filter(F.col("rank") <= top))
    counts = kinds.groupBy("property_id", "loss_kind").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"))
    order = [F.col("n").desc(), F.col("first_rank").asc()]
    return top_per(counts, ["property_id"], order, 1).select("property_id", "loss_kind", "n")


def page_scatter(pages: DataFrame, limit: int = TOP_N) -> DataFrame:
    """Position against impressions for the most visible pages, coloured by the median CTR."""
    top = top_rows(pages, "page", "impressions", limit).filter(
        "impressions > 0 AND position IS NOT NULL")
    w = Window.partitionBy("property_id")
    placed = top.withColumns({
        "c": F.coalesce("ctr", F.lit(0.0)), "n": F.count("*").over(w),
    }).withColumn("rn", F.row_number().over(w.orderBy("c")))
    middle = F.max(F.expr("if(rn = n div 2 + 1, c, null)")).over(w)
    return placed.withColumn("at_or_above_median", F.col("c") >= middle).select(
        "property_id", "page", "clicks", "impressions", "position", "at_or_above_median", "rank")
