"""Rules over organic-search figures. `type` is the subject, `detail` the report group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import SEARCH_KPIS, SEARCH_SMALL_CLICKS, SEARCH_SMALL_IMPRESSIONS
from ..functions.display import SEARCH_STYLE, delta_text, grouped, percent_text, plain
from .findings import fire, ordered, priority_rank, rule, union_findings, with_lines
from .search import dominant_loss_kind, with_loss_kind

OUT = ["property_id", "id", "type", "severity", "confidence", "scope", "entity", "amount",
       "detail", "evidence"]


def _in(group: str) -> dict[str, str]:
    return {"detail": f"'{group}'", "scope": "'property'"}


def kpi_findings(kpis: DataFrame, attribution: DataFrame, shape: DataFrame) -> DataFrame:
    """Headline rules, the attribution of the click change and the shape of the period."""
    base = f"if(coalesce(k_clicks.current, 0) < {SEARCH_SMALL_CLICKS}, 'low', 'high')"
    stable = "k_average_position.availability = 'available' AND NOT k_average_position.material"
    names = [f"k_{k.key}" for k in SEARCH_KPIS]
    all_new = " AND ".join(f"({n}.current IS NULL OR {n}.verdict = 'new')" for n in names)
    none_material = " AND ".join(f"NOT {n}.material" for n in names)
    clicks, imps, ctr, pos = "e_clicks", "e_impressions", "e_ctr", "e_average_position"
    rules = [
        rule("k_clicks.verdict = 'improved'", "'clicks_up'", "'traffic'", "'high'", base,
             evidence=[clicks, imps], **_in("strengths")),
        rule("k_clicks.verdict = 'declined'", "'clicks_down'", "'traffic'", "'high'", base,
             evidence=[clicks, imps, ctr], **_in("weaknesses")),
        rule("k_impressions.verdict = 'improved' AND k_clicks.verdict <> 'improved'",
             "'impressions_up_clicks_flat'", "'visibility'", "'medium'", base,
             evidence=[imps, clicks, ctr, pos], **_in("observations")),
        rule("k_clicks.verdict = 'declined' "
             "AND k_clicks.percent_change < k_impressions.percent_change - 5",
             "'clicks_falling_faster'", "'ctr'", "'high'", base,
             evidence=[clicks, imps, ctr, pos], **_in("weaknesses")),
        rule(f"k_ctr.verdict = 'declined' AND {stable}", "'ctr_down_position_stable'", "'ctr'",
             "'high'", base,
             amount="abs(coalesce(k_impressions.current, 0) * k_ctr.absolute_change / 100.0D)",
             evidence=[ctr, pos, imps], **_in("weaknesses")),
        rule("k_ctr.verdict = 'improved' AND k_clicks.verdict <> 'declined'", "'ctr_up'", "'ctr'",
             "'medium'", base, evidence=[ctr, imps, clicks], **_in("strengths")),
        rule("k_average_position.verdict = 'improved'", "'position_improved'", "'ranking'",
             "'medium'", "'medium'", evidence=[pos, imps], **_in("strengths")),
        rule("k_average_position.verdict = 'improved' AND k_clicks.verdict = 'declined'",
             "'position_up_clicks_down'", "'ranking'", "'medium'", "'medium'",
             evidence=[pos, clicks, imps], **_in("observations")),
        rule("k_average_position.verdict = 'declined'", "'position_declined'", "'ranking'",
             "'medium'", "'medium'", evidence=[pos, imps, clicks], **_in("weaknesses")),
        rule(all_new, "'no_baseline'", "'coverage'", "'medium'", "'high'",
             evidence=[clicks, imps], **_in("observations")),
        rule(f"NOT ({all_new}) AND {none_material}", "'broadly_flat'", "'trend'", "'low'", base,
             evidence=[clicks, imps, ctr, pos], **_in("observations")),
        rule("k_clicks.material AND dominant_factor IS NOT NULL", "'click_attribution'",
             "'attribution'", "'low'", "'high'",
             evidence=["concat('Impressions component: ', "
                       + delta_text("explained_by_impressions", "int") + ")",
                       "concat('CTR component: ', " + delta_text("explained_by_ctr", "int") + ")",
                       "concat('Actual change: ', " + delta_text("actual_click_change", "int") + ")"],
             **_in("observations")),
        rule("trend = 'falling' AND abs(change_pct) >= 20", "'declining_within_period'",
             "'trend'", "'high'", "'medium'", amount="change_pct",
             evidence=[f"concat('Second half against first: ', {percent_text('change_pct')})"],
             **_in("risks")),
        rule("trend = 'rising' AND change_pct >= 20", "'rising_within_period'", "'trend'",
             "'medium'", "'medium'", amount="change_pct",
             evidence=[f"concat('Second half against first: ', {percent_text('change_pct')})"],
             **_in("strengths")),
    ]
    joined = with_lines(kpis, SEARCH_KPIS, style=SEARCH_STYLE).join(
        attribution.drop("material"), "property_id", "left").join(shape, "property_id", "left")
    return fire(joined, rules)


def anomaly_findings(anomalies: DataFrame, limit: int = 6) -> DataFrame:
    w = Window.partitionBy("property_id").orderBy("date", "metric")
    first = anomalies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return fire(first, [
        rule("true", "concat('anomaly:', date, ':', metric)", "'anomaly'",
             "if(kind = 'spike', 'low', 'medium')", "confidence", "'day'", "date",
             amount="deviation", detail="'anomalies'",
             evidence=[f"concat(metric, ' on ', date, ': ', {grouped('value', 0)}, ' against ', "
                       f"{grouped('typical', 0)})"]),
    ])


def row_change_clause() -> str:
    """One clause naming what moved for a record; SQL text over a record with `loss_kind`."""
    kind = "if(clicks_change < 0, loss_kind, NULL)"
    position = f"{plain('previous_position', 1)}, ' to ', {plain('position', 1)}"
    return (
        f"CASE WHEN {kind} = 'ranking' THEN concat('position moved from ', {position}) "
        f"WHEN {kind} = 'visibility' THEN concat('impressions fell ', "
        f"{percent_text('impressions_change_pct')}) "
        f"WHEN {kind} = 'ctr' THEN concat('CTR fell ', {delta_text('ctr_change_points', 'rate')}) "
        f"WHEN clicks_change > 0 AND position_change < -0.3D "
        f"THEN concat('position improved from ', {position}) "
        f"WHEN clicks_change > 0 AND impressions_change > 0 "
        f"THEN concat('impressions rose ', {percent_text('impressions_change_pct')}) "
        f"ELSE concat('impressions ', {delta_text('impressions_change', 'int')}, ', position ', "
        f"{delta_text('position_change', 'position')}) END"
    )


def with_row_change(records: DataFrame) -> DataFrame:
    return with_loss_kind(records).withColumn("row_change", F.expr(row_change_clause()))


def list_finding(
    ranked: DataFrame, id: str, type: str, severity: str, confidence: str, scope: str, group: str,
    line: str, amount: str = "NULL",
) -> DataFrame:
    """One finding per property from a ranked list of at most ten rows; five become evidence."""
    lines = F.sort_array(F.collect_list(
        F.when(F.col("rank") <= 5, F.struct("rank", F.expr(line).alias("line")))))
    grouped_ = ranked.groupBy("property_id").agg(
        F.count("*").alias("n"), F.expr(f"CAST({amount} AS DOUBLE)").alias("amount"),
        F.transform(lines, lambda s: s["line"]).alias("evidence"),
    )
    return grouped_.selectExpr(
        "property_id", f"'{id}' AS id", f"'{type}' AS type", f"{severity} AS severity",
        f"'{confidence}' AS confidence", f"'{scope}' AS scope", "CAST(NULL AS STRING) AS entity",
        "amount", f"'{group}' AS detail", "evidence",
    )


def _moved(key: str) -> str:
    return (f"concat({key}, ': ', {delta_text('clicks_change', 'int')}, ' clicks, position ', "
            f"coalesce({plain('previous_position', 1)}, 'n/a'), ' to ', "
            f"coalesce({plain('position', 1)}, 'n/a'))")


def dimension_findings(label: str, lists: dict[str, DataFrame], concentration: DataFrame) -> DataFrame:
    """Findings over one dimension's lists: losers, winners, visibility, ctr, ranking."""
    seen = f"concat({label}, ': ', {grouped('impressions', 0)}, ' impressions')"
    parts = [
        list_finding(lists["losers"], f"{label}_losses", "traffic", "if(n >= 3, 'high', 'medium')",
                     "high", label, "weaknesses", _moved(label)),
        list_finding(lists["winners"], f"{label}_gains", "traffic", "'medium'", "high", label,
                     "strengths", _moved(label)),
        concentration.filter("top_n_share_pct >= 60").selectExpr(
            "property_id", f"'{label}_loss_concentration' AS id", "'concentration' AS type",
            "'medium' AS severity", "'high' AS confidence", f"'{label}' AS scope",
            "CAST(NULL AS STRING) AS entity", "top_n_share_pct AS amount", "'risks' AS detail",
            "entities AS evidence"),
        list_finding(lists["visibility"], f"{label}_visibility_losses", "visibility", "'medium'",
                     "medium", label, "risks",
                     f"concat({label}, ': impressions ', "
                     f"{delta_text('impressions_change', 'int')}, ' [', loss_kind, ']')"),
        list_finding(lists["ctr"], f"{label}_ctr_opportunities", "ctr", "'medium'", "medium",
                     label, "opportunities", seen, "sum(clicks_at_band_median)"),
        list_finding(lists["ranking"], f"{label}_ranking_opportunities", "ranking", "'medium'",
                     "medium", label, "opportunities", seen),
    ]
    return union_findings(parts)


def device_findings(devices: DataFrame) -> DataFrame:
    return fire(devices, [
        rule(f"impressions >= {SEARCH_SMALL_IMPRESSIONS} AND ctr_change_points <= -0.4D "
             "AND device <> ''", "concat('device_ctr_decline:', device)", "'ctr'", "'medium'",
             "'medium'", "'device'", "device", amount="ctr_change_points", detail="'weaknesses'",
             evidence=[_moved("device")]),
    ])


def country_findings(countries: DataFrame, kpis: DataFrame) -> DataFrame:
    """Up to three markets that moved against the property, taken in order of clicks."""
    joined = countries.filter("material AND rank <= 15").join(
        kpis.selectExpr("property_id", "k_clicks.percent_change AS property_pct"), "property_id")
    moved = joined.filter(
        "abs(clicks_change) >= 50 AND share_of_clicks_pct >= 5 AND (property_pct IS NULL "
        "OR clicks_change_pct IS NULL OR abs(clicks_change_pct - property_pct) >= 15)")
    w = Window.partitionBy("property_id").orderBy("rank")
    first = moved.withColumn("n", F.row_number().over(w)).filter("n <= 3")
    return fire(first, [
        rule("true", "concat('country_move:', country)", "'geography'", "'low'", "'medium'",
             "'country'", "country", amount="clicks_change", detail="'observations'",
             evidence=[_moved("upper(country)")]),
    ])


def cannibal_findings(signals: DataFrame, limit: int = 3) -> DataFrame:
    return fire(signals.filter(F.col("rank") <= limit), [
        rule("true", "concat('cannibalisation:', query)", "'cannibalisation'", "'low'", "'low'",
             "'query'", "query", amount="second_page_share_pct", detail="'observations'",
             evidence=["concat(CAST(pages AS STRING), ' pages hold impressions for this query')"]),
    ])


def indexing_findings(inspected: DataFrame) -> DataFrame:
    """URL status rows that are neither passed nor indexed."""
    good = ("upper(coalesce(verdict, '')) = 'PASS' "
            "AND contains(lower(coalesce(coverage_state, '')), 'indexed')")
    return fire(inspected, [
        rule(f"NOT ({good})", "concat('indexing:', url)", "'indexing'", "'high'", "'medium'",
             "'page'", "url", detail="'risks'",
             evidence=["concat('Coverage: ', coalesce(coverage_state, 'unknown'))",
                       "concat('Robots: ', coalesce(robots_txt_state, 'not reported'))"]),
    ])


def recommendations(
    query_lists: dict[str, DataFrame], page_lists: dict[str, DataFrame], findings: DataFrame,
    owners: DataFrame | None = None, truncated: DataFrame | None = None,
) -> DataFrame:
    """Actions from the lists and findings; an empty analysis yields none.

    `truncated` has one row per property whose export hit the row cap.
    """
    def row(df, finding, action, priority, confidence, amount="NULL", entity="NULL"):
        return df.selectExpr(
            "property_id", f"{finding} AS from_finding", f"{action} AS action",
            f"{priority} AS priority", f"{confidence} AS confidence",
            f"CAST({entity} AS STRING) AS entity", f"CAST({amount} AS DOUBLE) AS amount")

    page_ctr = row(
        page_lists["ctr"].filter("rank <= 3"), "'page_ctr_opportunities'",
        "concat('Rewrite title and description of ', page)",
        "if(NOT ceiling_is_speculative AND clicks_at_band_median >= 50, 'High', 'Medium')",
        "if(ceiling_is_speculative, 'low', 'medium')", "clicks_at_band_median", "page")
    shown, ranked = query_lists["ctr"].filter("rank <= 2"), query_lists["ranking"].filter("rank <= 3")
    hint = "''"
    if owners is not None:
        own = owners.select("property_id", "query", F.col("page").alias("owner"))
        shown = shown.join(own, ["property_id", "query"], "left")
        ranked = ranked.join(own, ["property_id", "query"], "left")
        hint = "coalesce(concat(' (answered by ', owner, ')'), '')"
    query_ctr = row(
        shown, "'query_ctr_opportunities'",
        f"concat('Review the search result shown for ', query, {hint})", "'Medium'", "'medium'",
        "clicks_at_band_median", "query")
    query_rank = row(
        ranked, "'query_ranking_opportunities'",
        f"concat('Strengthen the page targeting ', query, {hint})", "'Medium'",
        "if(band = '11-20', 'low', 'medium')", "opportunity_score", "query")
    losers = page_lists["losers"]
    sums = losers.filter("rank <= 5").groupBy("property_id").agg(
        F.abs(F.sum("clicks_change")).alias("amount"),
        F.max(F.when(F.col("rank") == 1, F.col("page"))).alias("worst"))
    loss = row(
        sums.join(dominant_loss_kind(losers), "property_id"), "'page_losses'",
        "concat('Work on the ', loss_kind, ' losses, starting with ', worst)", "'High'",
        "'medium'", "amount", "worst")
    indexing = row(
        findings.filter("type = 'indexing'"), "id",
        "concat('Check the index status of ', entity)", "'High'", "'medium'", entity="entity")
    presentation = row(
        findings.filter("id = 'ctr_down_position_stable'"), "id",
        "'Audit how the top ten pages appear in search results'", "'High'", "'medium'", "amount")
    parts = [page_ctr, query_ctr, query_rank, loss, indexing, presentation]
    if truncated is not None:
        parts.append(row(truncated, "'data_quality'",
                         "'Re-run the export in smaller date slices'", "'Medium'", "'high'"))
    out = union_findings(parts).withColumn("priority_rank", priority_rank(F.col("priority")))
    return ordered(out)
