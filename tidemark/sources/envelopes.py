"""Raw retrieval documents: one JSON envelope per account and run.

Every envelope has a schema tag, periods and datasets; a dataset holds a list (rows or none) or
null when its request failed. The three states stay apart all the way through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import (
    DIMENSION_ALIASES, KEY_EVENT_METRICS, LEGACY_KEY_EVENT_METRICS, WEB_CANONICAL,
    WEB_RATE_METRICS,
)
from ..functions.dates import compact_date
from ..functions.nulls import to_count, to_number

PERIODS = ("periods struct<current:struct<start:date,end:date,days:int>,"
           "previous:struct<start:date,end:date,days:int>,basis:string,time_zone:string>")
ERRORS = ("errors array<struct<dataset:string,required:boolean,message:string,error_code:string,"
          "http_status:int,retryable:boolean>>, warnings array<string>")

ADS_ROW = (
    "struct<campaign:struct<id:string,name:string,status:string,advertisingChannelType:string,"
    "advertisingChannelSubType:string,biddingStrategyType:string>,"
    "campaignBudget:struct<amountMicros:string,explicitlyShared:boolean>,"
    "adGroup:struct<id:string,name:string,status:string>,"
    "adGroupCriterion:struct<status:string,keyword:struct<text:string,matchType:string>>,"
    "searchTermView:struct<searchTerm:string,status:string>,"
    "conversionAction:struct<name:string,category:string,type:string,status:string,"
    "primaryForGoal:boolean,countingType:string,includeInConversionsMetric:boolean>,"
    "segments:struct<date:string,device:string,adNetworkType:string,conversionActionName:string,"
    "conversionActionCategory:string>,"
    "metrics:struct<impressions:string,clicks:string,costMicros:string,averageCpc:string,"
    "ctr:double,conversions:double,conversionsValue:double,allConversions:double,"
    "allConversionsValue:double,searchImpressionShare:double,"
    "searchBudgetLostImpressionShare:double,searchRankLostImpressionShare:double,"
    "searchAbsoluteTopImpressionShare:double>>"
)
ADS_DATASETS = [
    "account_totals", "daily", "campaigns", "device", "network", "ad_groups", "keywords",
    "search_terms", "conversion_performance", "conversion_actions_meta",
]
ADS_ENVELOPE = (
    "schema string, generated_at string, account struct<customer_id:string,name:string,"
    "currency:string,time_zone:string,status:string,is_manager:boolean,is_test_account:boolean>, "
    f"{PERIODS}, datasets struct<"
    + ",".join(f"{d}:struct<current:array<{ADS_ROW}>,previous:array<{ADS_ROW}>>"
               for d in ADS_DATASETS)
    + f">, {ERRORS}"
)

_WEB_REPORT = ("struct<rows:array<struct<keys:array<string>,values:map<string,double>>>,"
               "totals:map<string,double>,row_count:int,meta:struct<currencyCode:string,"
               "timeZone:string,dataLossFromOtherRow:boolean,subjectToThresholding:boolean,"
               "emptyReason:string,samplingMetadatas:array<string>>>")
WEB_DATASETS = [
    "totals", "daily", "channels", "source_medium", "campaigns", "first_user_channels",
    "landing_pages", "pages", "hostname", "devices", "browsers", "operating_systems", "platforms",
    "geo_country", "geo_region", "geo_city", "events", "items", "revenue_by_channel",
    "revenue_by_device",
]
WEB_ENVELOPE = (
    "schema string, property struct<property_id:string,name:string,time_zone:string,"
    f"currency:string>, {PERIODS}, schema_support struct<metadata_loaded:boolean>, "
    "key_events struct<metric_naming:string,metrics_used:array<string>,"
    "definitions:array<struct<event_name:string,counting_method:string>>,"
    "declared_in_env:array<string>>, ecommerce struct<state:string,reason:string>, "
    "datasets struct<"
    + ",".join(f"{d}:struct<limit:int,current:{_WEB_REPORT},previous:{_WEB_REPORT}>"
               for d in WEB_DATASETS)
    + f">, {ERRORS}"
)

_SEARCH_PERIOD = ("struct<rows:array<struct<query:string,page:string,date:string,device:string,"
                  "country:string,searchAppearance:string,clicks:bigint,impressions:bigint,"
                  "ctr:double,position:double>>,meta:struct<rows_returned:int,truncated:boolean,"
                  "complete:boolean,pages_fetched:int>>")
SEARCH_DATASETS = ["totals", "daily", "queries", "pages", "query_page", "devices", "countries",
                   "search_appearance"]
SEARCH_ENVELOPE = (
    "schema string, property struct<site_url:string,property_type:string,"
    f"permission_level:string,display:string>, {PERIODS}, search_type string, data_state string, "
    "freshness struct<latest_final:date,latest_including_fresh:date,lag_days:int,"
    "fresh_days_available:int>, settings struct<brand_terms:array<string>>, datasets struct<"
    + ",".join(f"{d}:struct<current:{_SEARCH_PERIOD},previous:{_SEARCH_PERIOD}>"
               for d in SEARCH_DATASETS)
    + f">, {ERRORS}"
)


def read_envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per document; the schema is given, so nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def gate(envelopes: DataFrame, tag: str, totals: str) -> DataFrame:
    """Add `reject_reason`: wrong tag, missing periods or missing totals. `totals` is SQL text."""
    return envelopes.withColumn("reject_reason", F.expr(
        f"CASE WHEN schema IS NULL OR schema <> '{tag}' THEN 'wrong schema tag' "
        "WHEN periods.current IS NULL OR periods.previous IS NULL THEN 'periods missing' "
        f"WHEN ({totals}) IS NULL THEN 'totals missing' END"))


def dataset_status(envelopes: DataFrame, datasets: list[str], rows: str = "") -> DataFrame:
    """property_id, dataset, period and `rows`, `empty` or `failed`.

    `rows` is the path from a period to its list (empty for lists, `.rows` for reports).
    """
    entries = ", ".join(
        f"struct('{d}' AS dataset, '{p}' AS period, CASE WHEN datasets.{d}.{p}{rows} IS NULL "
        f"THEN 'failed' WHEN size(datasets.{d}.{p}{rows}) = 0 THEN 'empty' ELSE 'rows' END AS status)"
        for d in datasets for p in ("current", "previous"))
    return envelopes.selectExpr("property_id", f"inline(array({entries}))")


def long_rows(envelopes: DataFrame, datasets: list[str], rows: str = "") -> DataFrame:
    """One row per dataset row: property_id, dataset, period, row."""
    entries = ", ".join(
        f"struct('{d}' AS dataset, '{p}' AS period, datasets.{d}.{p}{rows} AS items)"
        for d in datasets for p in ("current", "previous"))
    return envelopes.selectExpr("property_id", f"inline(array({entries}))").selectExpr(
        "property_id", "dataset", "period", "posexplode(items) AS (seq, row)")


def field(path: str) -> Column:
    """A nested snake_case path as a column of camelCase fields; null when a level is missing."""
    parts = []
    for part in path.split("."):
        head, *rest = part.split("_")
        parts.append(head + "".join(w[:1].upper() + w[1:] for w in rest))
    return F.col(".".join(parts))


def ads_facts(rows: DataFrame) -> DataFrame:
    """Flat facts from long ads rows: counts parsed from text, money from micros."""
    m = lambda name: field(f"row.metrics.{name}")
    micros = to_count(m("cost_micros"))
    return rows.select(
        "property_id", "dataset", "period", "seq",
        field("row.campaign.id").alias("campaign_id"), field("row.campaign.name").alias("name"),
        field("row.campaign.status").alias("status"),
        field("row.campaign.advertising_channel_type").alias("channel_type"),
        field("row.campaign.bidding_strategy_type").alias("bidding_strategy"),
        (to_count(field("row.campaign_budget.amount_micros")) / F.lit(1e6)).alias("daily_budget"),
        F.try_to_date(field("row.segments.date"), "yyyy-MM-dd").alias("date"),
        field("row.segments.device").alias("device"),
        field("row.segments.ad_network_type").alias("network"),
        field("row.segments.conversion_action_name").alias("conversion_action"),
        field("row.segments.conversion_action_category").alias("conversion_category"),
        to_count(m("impressions")).alias("impressions"), to_count(m("clicks")).alias("clicks"),
        (micros.cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)").alias("cost"),
        m("ctr").alias("reported_ctr"),
        m("conversions").alias("conversions"), m("conversions_value").alias("conversions_value"),
        m("all_conversions").alias("all_conversions"),
        m("all_conversions_value").alias("all_conversions_value"),
        m("search_impression_share").alias("impression_share"),
        m("search_budget_lost_impression_share").alias("lost_budget"),
        m("search_rank_lost_impression_share").alias("lost_rank"),
        (F.col("period") == "current").alias("in_current"),
        (F.col("period") == "previous").alias("in_previous"),
    )


def last_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A key repeated inside one dataset and period keeps its last row by position."""
    last = rows.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return rows.join(last, [*keys, "seq"], "left_semi")


def search_facts(rows: DataFrame) -> DataFrame:
    """Flat facts from long search rows."""
    return rows.select(
        "property_id", "dataset", "period", "row.*",
        (F.col("period") == "current").alias("in_current"),
        (F.col("period") == "previous").alias("in_previous"),
    ).withColumnRenamed("searchAppearance", "appearance")


def canonical_metrics(values: Column) -> Column:
    """Metric map with current names, and fractions as percentage points."""
    rates = F.array(*[F.lit(m) for m in WEB_RATE_METRICS])
    scaled = F.transform_values(
        values, lambda k, v: F.when(F.array_contains(rates, k), v * 100.0).otherwise(v))
    names = F.create_map(*[F.lit(x) for pair in WEB_CANONICAL.items() for x in pair])
    return F.transform_keys(scaled, lambda k, v: F.coalesce(F.try_element_at(names, k), k))


def web_metrics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Named metric columns from long web rows; an absent metric is null."""
    named = rows.select(
        "property_id", "dataset", "period", F.col("row.keys").alias("keys"),
        canonical_metrics(F.col("row.values")).alias("values"))
    return named.select(
        "property_id", "dataset", "period", "keys", F.array_join("keys", " / ").alias("key"),
        *[F.try_element_at("values", F.lit(m)).alias(m) for m in metrics])


def web_daily(rows: DataFrame) -> DataFrame:
    """Daily web rows with their date parsed; text that is no date stays text."""
    return rows.withColumn("date", compact_date(F.try_element_at("keys", F.lit(1))))


def report_totals(report: Column) -> Column:
    """Totals map of a report: its totals, else its first row, else null."""
    first = F.try_element_at(report["rows"], F.lit(1))["values"]
    return canonical_metrics(F.coalesce(F.when(F.size(report["totals"]) > 0, report["totals"]), first))


def positional_report(rows: DataFrame) -> DataFrame:
    """Values by position to a map by metric name.

    Rows have `metric_headers` and `metric_values` (text). A short value list leaves the rest null.
    """
    padded = F.transform(
        "metric_headers", lambda h, i: to_number(F.try_element_at("metric_values", i + F.lit(1))))
    return rows.withColumn("values", F.map_from_arrays("metric_headers", padded))


def search_row(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Search rows with `keys` by position; a short key list leaves the rest null."""
    return rows.select(
        *[c for c in rows.columns if c not in ("keys", "clicks", "impressions", "ctr", "position")],
        *[F.try_element_at("keys", F.lit(i)).alias(d) for i, d in enumerate(dimensions, start=1)],
        *[to_number(F.col(m).cast("string")).alias(m)
          for m in ("clicks", "impressions", "ctr", "position")])


def metric_support(properties: DataFrame, requested: list[str]) -> DataFrame:
    """Which requested metrics each property can report.

    `properties` has property_id and an array `metrics`, null when no metadata was loaded: then
    every metric is kept.
    """
    wanted = F.explode(F.array(*[F.lit(m) for m in requested])).alias("metric")
    pairs = properties.select("property_id", "metrics", wanted)
    supported = F.col("metrics").isNull() | F.array_contains("metrics", F.col("metric"))
    return pairs.select(
        "property_id", "metric", supported.alias("supported"),
        F.when(~supported, "not in this property's metric schema").alias("reason"))


def first_dimension(properties: DataFrame, role: str, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    """The first dimension name of a role that each property knows. `keys` name a property."""
    options = [F.when(F.col("dimensions").isNull() | F.array_contains("dimensions", name),
                      F.lit(name)) for name in DIMENSION_ALIASES[role]]
    return properties.select(*keys, F.coalesce(*options, F.lit(None)).alias("dimension"))


def key_event_vocabulary(properties: DataFrame, keys: Sequence[str] = ("property_id",)) -> DataFrame:
    """Current key-event metrics, else the older trio, else none. `keys` name a property."""
    def has_all(names):
        return F.col("metrics").isNull() | (
            F.size(F.array_intersect("metrics", F.array(*[F.lit(n) for n in names]))) == len(names))

    return properties.select(*keys, F.when(has_all(KEY_EVENT_METRICS), "keyEvents").when(
        has_all(LEGACY_KEY_EVENT_METRICS), "conversions").alias("metric_naming"))


def sitemaps(exported: DataFrame) -> DataFrame:
    """Sitemap list with submitted and indexed summed over contents; a zero sum means unknown."""
    def total(name: str) -> str:
        return (f"nullif(aggregate(transform(coalesce(contents, array()), "
                f"c -> coalesce(try_cast(c.{name} AS BIGINT), 0L)), 0L, (a, x) -> a + x), 0L)")

    return exported.selectExpr(
        "property_id", "path", "lastDownloaded AS last_downloaded", "isPending AS is_pending",
        "try_cast(warnings AS BIGINT) AS warnings", "try_cast(errors AS BIGINT) AS errors",
        f"{total('submitted')} AS submitted", f"{total('indexed')} AS indexed")


INDEX_RESULT = (
    "struct<indexStatusResult:struct<verdict:string,coverageState:string,robotsTxtState:string,"
    "indexingState:string,pageFetchState:string,lastCrawlTime:string,crawledAs:string,"
    "googleCanonical:string,userCanonical:string,sitemap:array<string>,"
    "referringUrls:array<string>>,mobileUsabilityResult:struct<verdict:string>,"
    "richResultsResult:struct<verdict:string>,inspectionResultLink:string>"
)


def index_status(exported: DataFrame) -> DataFrame:
    """Flat URL index status from exported inspection results (column `result` as JSON text)."""
    parsed = exported.withColumn("r", F.from_json("result", INDEX_RESULT))
    names = {
        "verdict": "verdict", "coverageState": "coverage_state",
        "robotsTxtState": "robots_txt_state", "indexingState": "indexing_state",
        "pageFetchState": "page_fetch_state", "lastCrawlTime": "last_crawl_time",
        "crawledAs": "crawled_as", "googleCanonical": "google_canonical",
        "userCanonical": "user_canonical", "sitemap": "sitemaps", "referringUrls": "referring_urls",
    }
    return parsed.select(
        "property_id", "url",
        *[F.col(f"r.indexStatusResult.{a}").alias(b) for a, b in names.items()],
        F.col("r.mobileUsabilityResult.verdict").alias("mobile_usability_verdict"),
        F.col("r.richResultsResult.verdict").alias("rich_results_verdict"),
        F.col("r.inspectionResultLink").alias("inspection_link"))
