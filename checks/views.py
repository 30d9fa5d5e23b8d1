"""Stand-in facts: the driver's tables shaped like the four inputs the library works on.

Each view exists twice, as a DataFrame and as a DuckDB CTE with the same meaning. FIXTURES.md lists
the columns. Scenario factors (a doubled budget, a property without values, a day booked to another
property) depend on stored columns, so that every rule has something to find at every scale.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.periods import Windows
from tidemark.session import configure

YEAR_WINDOWS = Windows(date(1999, 1, 1), date(1999, 12, 31), date(1998, 1, 1), date(1998, 12, 31))
EVENT_WINDOWS = Windows(date(2024, 1, 16), date(2024, 1, 30), date(2024, 1, 1), date(2024, 1, 15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# --- paid ads -------------------------------------------------------------------------------

AD_SQL = """
ad AS (
  SELECT n_name AS property_id, l_suppkey AS campaign_id, l_returnflag AS device,
    l_linestatus AS network, CAST(l_shipdate AS DATE) AS date,
    'g' || (l_partkey % 10) AS ad_group, 'kw ' || l_partkey AS keyword,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE 'action_' || l_linenumber END AS conversion_action,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'CAT_' || (l_linenumber % 3) END AS conversion_category,
    CAST(l_quantity * 100 AS BIGINT) AS impressions,
    CASE WHEN l_suppkey % 9 = 5 THEN CAST(floor(l_quantity / 40) AS BIGINT)
         ELSE CAST(l_quantity AS BIGINT) END AS clicks,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2))
      * CASE WHEN l_suppkey % 4 = 0 AND year(l_shipdate) = 1999 THEN 2 ELSE 1 END AS DECIMAL(18,2)) AS cost,
    CASE WHEN n_nationkey = 7 OR l_suppkey % 11 = 3 THEN 0
         WHEN CAST(l_discount AS DECIMAL(4,2)) >= 0.05 THEN 1 + l_linenumber % 3 ELSE 0 END AS conversions,
    CASE WHEN n_nationkey % 6 = 5 THEN NULL
         WHEN n_nationkey = 7 OR l_suppkey % 11 = 3 THEN 0
         WHEN CAST(l_discount AS DECIMAL(4,2)) >= 0.05 THEN (1 + l_linenumber % 3)
           * CASE WHEN n_nationkey = 9 THEN 1 ELSE l_partkey % 50 + 10 END
         ELSE 0 END AS conversions_value,
    CASE WHEN l_linenumber = 6 THEN 0 ELSE l_linenumber % 2 + l_partkey % 3 END AS all_conversions,
    CASE WHEN l_linenumber = 6 THEN 0 ELSE l_partkey % 100 END AS all_conversions_value,
    CASE WHEN l_linenumber = 1 OR l_suppkey % 5 = 2 THEN NULL
         ELSE CAST(l_tax AS DECIMAL(4,2)) * 10 END AS impression_share,
    CASE WHEN l_linenumber = 1 OR l_suppkey % 5 = 2 THEN NULL
         ELSE CAST(l_discount AS DECIMAL(4,2)) * 3 END AS lost_budget,
    CASE WHEN l_linenumber = 1 OR l_suppkey % 5 = 2 THEN NULL
         ELSE (0.08 - CAST(l_tax AS DECIMAL(4,2))) * CASE WHEN l_suppkey % 3 = 0 THEN 8 ELSE 5 END
    END AS lost_rank
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
),
campaign_dim AS (
  SELECT n_name AS property_id, s_suppkey AS campaign_id, s_name AS name,
    CASE WHEN s_suppkey % 10 = 3 THEN 'PAUSED' ELSE 'ENABLED' END AS status,
    CASE s_suppkey % 5 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'SHOPPING' WHEN 2 THEN 'PERFORMANCE_MAX'
         WHEN 3 THEN 'DISPLAY' ELSE 'APP' END AS channel_type,
    CASE WHEN s_suppkey % 2 = 0 THEN 'TARGET_CPA' ELSE 'MAXIMIZE_CLICKS' END AS bidding_strategy,
    CAST(s_acctbal AS DECIMAL(18,2)) AS daily_budget
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
adw AS (
  SELECT *, date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AS in_current,
    date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AS in_previous
  FROM ad WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
)"""


def ad_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.selectExpr(
        "n_name AS property_id", "l_suppkey AS campaign_id", "l_returnflag AS device",
        "l_linestatus AS network", "CAST(l_shipdate AS DATE) AS date",
        "'g' || (l_partkey % 10) AS ad_group", "'kw ' || l_partkey AS keyword",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE 'action_' || l_linenumber END AS conversion_action",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'CAT_' || (l_linenumber % 3) END AS conversion_category",
        "CAST(l_quantity * 100 AS BIGINT) AS impressions",
        "IF(l_suppkey % 9 = 5, CAST(floor(l_quantity / 40) AS BIGINT), CAST(l_quantity AS BIGINT)) AS clicks",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * IF(l_suppkey % 4 = 0 AND year(l_shipdate) = 1999, 2, 1) AS DECIMAL(18,2)) AS cost",
        """CASE WHEN n_nationkey = 7 OR l_suppkey % 11 = 3 THEN 0L
             WHEN CAST(l_discount AS DECIMAL(4,2)) >= 0.05 THEN 1L + l_linenumber % 3 ELSE 0L END AS conversions""",
        """CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_nationkey = 7 OR l_suppkey % 11 = 3 THEN 0L
             WHEN CAST(l_discount AS DECIMAL(4,2)) >= 0.05
               THEN (1 + l_linenumber % 3) * IF(n_nationkey = 9, 1L, l_partkey % 50 + 10)
             ELSE 0L END AS conversions_value""",
        "IF(l_linenumber = 6, 0L, l_linenumber % 2 + l_partkey % 3) AS all_conversions",
        "IF(l_linenumber = 6, 0L, l_partkey % 100) AS all_conversions_value",
        "IF(l_linenumber = 1 OR l_suppkey % 5 = 2, NULL, CAST(l_tax AS DECIMAL(4,2)) * 10) AS impression_share",
        "IF(l_linenumber = 1 OR l_suppkey % 5 = 2, NULL, CAST(l_discount AS DECIMAL(4,2)) * 3) AS lost_budget",
        """IF(l_linenumber = 1 OR l_suppkey % 5 = 2, NULL,
             (0.08 - CAST(l_tax AS DECIMAL(4,2))) * IF(l_suppkey % 3 = 0, 8, 5)) AS lost_rank""",
    )


def campaign_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return rows.selectExpr(
        "n_name AS property_id", "s_suppkey AS campaign_id", "s_name AS name",
        "IF(s_suppkey % 10 = 3, 'PAUSED', 'ENABLED') AS status",
        """CASE s_suppkey % 5 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'SHOPPING' WHEN 2 THEN 'PERFORMANCE_MAX'
             WHEN 3 THEN 'DISPLAY' ELSE 'APP' END AS channel_type""",
        "IF(s_suppkey % 2 = 0, 'TARGET_CPA', 'MAXIMIZE_CLICKS') AS bidding_strategy",
        "CAST(s_acctbal AS DECIMAL(18,2)) AS daily_budget",
    )


# Conversion set-up per property: seven actions, one of them never in the facts.
ACTION_META_SQL = """
action_meta AS (
  SELECT n_name AS property_id, 'action_' || i AS name,
    CASE WHEN i % 2 = 0 THEN 'META_CAT' ELSE NULL END AS category,
    CASE WHEN i = 2 THEN 'REMOVED' ELSE 'ENABLED' END AS status,
    'ONE_PER_CLICK' AS counting_type
  FROM nation, (SELECT unnest([1,2,3,4,5,6,8]) AS i)
)"""


def action_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .select(F.col("n_name").alias("property_id"),
                F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4, 5, 6, 8)])).alias("i"))
        .selectExpr(
            "property_id", "'action_' || i AS name",
            "IF(i % 2 = 0, 'META_CAT', NULL) AS category",
            "IF(i = 2, 'REMOVED', 'ENABLED') AS status", "'ONE_PER_CLICK' AS counting_type",
        )
    )


# --- organic search -------------------------------------------------------------------------

SEARCH_SQL = """
search AS (
  SELECT r_name AS property_id, 'p' || l_partkey AS query,
    'https://www.' || lower(r_name) || '.example.com/s/' || l_suppkey || '?ref=serp' AS page,
    l_returnflag AS device, n_name AS country,
    CASE WHEN l_linenumber = 7 THEN 'image' ELSE 'web' END AS search_type,
    CASE WHEN l_linenumber IN (2, 3) THEN 'RICH_RESULT' WHEN l_linenumber = 4 THEN 'VIDEO' END AS appearance,
    CASE WHEN l_linestatus = 'F' THEN 'final' ELSE 'fresh' END AS state,
    CAST(l_shipdate AS DATE) AS date,
    CAST(l_quantity * 100 AS BIGINT) AS impressions,
    CAST(floor(CAST(l_quantity AS BIGINT) * 10 * (1 - CAST(l_discount AS DECIMAL(4,2)) * 8)) AS BIGINT) AS clicks,
    CAST(1 + CAST(l_tax AS DECIMAL(4,2)) * 250
      + CASE WHEN year(l_shipdate) = 1999 AND r_regionkey = 1 THEN 1 ELSE 0 END AS DECIMAL(6,2)) AS position
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
),
searchw AS (
  SELECT *, date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AS in_current,
    date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AS in_previous
  FROM search WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
)"""


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.selectExpr(
        "r_name AS property_id", "'p' || l_partkey AS query",
        "'https://www.' || lower(r_name) || '.example.com/s/' || l_suppkey || '?ref=serp' AS page",
        "l_returnflag AS device", "n_name AS country",
        "IF(l_linenumber = 7, 'image', 'web') AS search_type",
        "CASE WHEN l_linenumber IN (2, 3) THEN 'RICH_RESULT' WHEN l_linenumber = 4 THEN 'VIDEO' END AS appearance",
        "IF(l_linestatus = 'F', 'final', 'fresh') AS state",
        "CAST(l_shipdate AS DATE) AS date",
        "CAST(l_quantity * 100 AS BIGINT) AS impressions",
        "CAST(floor(CAST(l_quantity AS BIGINT) * 10 * (1 - CAST(l_discount AS DECIMAL(4,2)) * 8)) AS BIGINT) AS clicks",
        """CAST(1 + CAST(l_tax AS DECIMAL(4,2)) * 250
             + IF(year(l_shipdate) = 1999 AND r_regionkey = 1, 1, 0) AS DECIMAL(6,2)) AS position""",
    )


# --- web analytics --------------------------------------------------------------------------

EVENT_SQL = """
web AS (
  SELECT
    CASE WHEN user_id % 3 = 0 THEN 'site-a'
         WHEN user_id % 3 = 1 THEN CASE WHEN CAST(ts AS DATE) = DATE '2024-01-25' THEN 'site-a' ELSE 'site-b' END
         WHEN CAST(ts AS DATE) IN (DATE '2024-01-20', DATE '2024-01-21') THEN 'site-d'
         ELSE 'site-c' END AS property_id,
    user_id, event_id, ts, CAST(ts AS DATE) AS date,
    CASE WHEN event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-16' THEN 'error_v2' ELSE event_type END AS event_name,
    event_type = 'purchase' AND k >= 25 OR event_type = 'signup' AND k >= 25 AND k % 3 <> 1 AS is_key,
    CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS revenue, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
),
webd AS (
  SELECT *, CASE k % 7 WHEN 0 THEN 'Organic Search' WHEN 1 THEN 'Direct' WHEN 2 THEN 'Paid Search'
      WHEN 3 THEN 'Referral' WHEN 4 THEN 'Email' WHEN 5 THEN '(not set)'
      ELSE CASE WHEN date >= DATE '2024-01-16' THEN 'Direct' ELSE 'Organic Social' END END AS channel,
    CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device,
    '/p/' || (k // 25) AS page,
    CASE WHEN date >= DATE '2024-01-16' AND user_id % 12 IN (3, 4, 5) AND k % 3 = 0 THEN 'Country 99'
         ELSE 'Country ' || (user_id % 12) END AS country
  FROM web
)"""


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    )
    return rows.selectExpr(
        """CASE WHEN user_id % 3 = 0 THEN 'site-a'
             WHEN user_id % 3 = 1 THEN IF(CAST(ts AS DATE) = DATE '2024-01-25', 'site-a', 'site-b')
             WHEN CAST(ts AS DATE) IN (DATE '2024-01-20', DATE '2024-01-21') THEN 'site-d'
             ELSE 'site-c' END AS property_id""",
        "user_id", "event_id", "ts", "CAST(ts AS DATE) AS date",
        "IF(event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-16', 'error_v2', event_type) AS event_name",
        "event_type = 'purchase' AND k >= 25 OR event_type = 'signup' AND k >= 25 AND k % 3 <> 1 AS is_key",
        "IF(event_type = 'purchase', CAST(value AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS revenue",
        """CASE k % 7 WHEN 0 THEN 'Organic Search' WHEN 1 THEN 'Direct' WHEN 2 THEN 'Paid Search'
             WHEN 3 THEN 'Referral' WHEN 4 THEN 'Email' WHEN 5 THEN '(not set)'
             ELSE IF(CAST(ts AS DATE) >= DATE '2024-01-16', 'Direct', 'Organic Social') END AS channel""",
        "CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device",
        "'/p/' || (k div 25) AS page",
        """IF(CAST(ts AS DATE) >= DATE '2024-01-16' AND user_id % 12 IN (3, 4, 5) AND k % 3 = 0, 'Country 99',
             'Country ' || (user_id % 12)) AS country""",
    )


# --- ledger ---------------------------------------------------------------------------------

LEDGER_SQL = """
booked AS (
  SELECT n_name AS client, o_orderkey AS line, c_name AS merchant, CAST(o_orderdate AS DATE) AS purchase_date,
    CASE n_nationkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'eur' WHEN 2 THEN ' usd ' ELSE '' END AS currency,
    CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'R-' || o_custkey || '-' || substr(o_orderpriority, 1, 1) END AS receipt_number,
    o_orderpriority AS category,
    CAST(0.50 + (o_orderkey % 50) / 100.0 AS DECIMAL(3,2)) AS confidence,
    'receipts/' || o_orderkey || '-1.jpg' AS file_path,
    CAST(o_orderdate + INTERVAL 30 HOUR AS TIMESTAMP) AS processed_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def booked_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return rows.selectExpr(
        "n_name AS client", "o_orderkey AS line", "c_name AS merchant",
        "CAST(o_orderdate AS DATE) AS purchase_date",
        "CASE n_nationkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'eur' WHEN 2 THEN ' usd ' ELSE '' END AS currency",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount",
        "IF(o_orderkey % 4 = 0, '', 'R-' || o_custkey || '-' || substr(o_orderpriority, 1, 1)) AS receipt_number",
        "o_orderpriority AS category",
        "CAST(0.50 + (o_orderkey % 50) / 100.0 AS DECIMAL(3,2)) AS confidence",
        "'receipts/' || o_orderkey || '-1.jpg' AS file_path",
        "CAST(o_orderdate AS TIMESTAMP_NTZ) + INTERVAL '30' HOUR AS processed_at",
    )
