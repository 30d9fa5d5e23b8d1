"""Sinks: analysis documents, KPI and breakdown exports, ledger appends and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import csv_cell
from ..operators.findings import priority_rank


BUCKETS = 64


def analysis_documents(
    kpis: DataFrame, findings: DataFrame, recommendations: DataFrame, period_end: str,
) -> DataFrame:
    """The analysis of every property as items: kind (kpi, finding or recommended_action), its place in
    the reading order, and the item as JSON.

    An item is a line of its own, so a property with very many findings keeps all of them and nothing
    is gathered. `priority`, then `name`, is the reading order within a kind.
    """
    def items(df: DataFrame, kind: str, priority: Column, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != "property_id"]
        return df.select(
            "property_id", F.lit(kind).alias("kind"), priority.cast("int").alias("priority"),
            F.col(name).cast("string").alias("name"), F.to_json(F.struct(*columns)).alias("item"))

    position = F.col("position") if "position" in kpis.columns else F.lit(0)
    parts = [
        items(kpis, "kpi", position, "key"),
        items(findings, "finding", priority_rank(F.initcap("severity")), "id"),
        items(recommendations, "recommended_action", F.col("priority_rank"), "from_finding"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("period_end", F.lit(period_end))


def write_analysis(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """JSON lines by period and hash bucket; the items of a property lie in one bucket."""
    documents.withColumn("bucket", F.pmod(F.xxhash64("property_id"), F.lit(buckets))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("period_end", "bucket").json(path)


def write_kpis(kpis: DataFrame, path: str, period_end: str) -> None:
    kpis.withColumn("period_end", F.lit(period_end)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("period_end").json(path)


def segment_csv(segments: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """Wide breakdown: label, current_* and previous_* cells."""
    cells = [f"{csv_cell(f'{p}{m}')} AS {long}_{m}"
             for p, long in (("cur_", "current"), ("prev_", "previous"))
             for m in metrics]
    return segments.selectExpr("property_id", f"key AS {label}", *cells)


def events_csv(events: DataFrame) -> DataFrame:
    """Every event with key-event mark and counts."""
    return events.selectExpr(
        "property_id", "event_name", "if(is_key_event, 'yes', 'no') AS is_key_event",
        f"{csv_cell('cur_eventCount')} AS current_event_count",
        f"{csv_cell('prev_eventCount')} AS previous_event_count",
        f"{csv_cell('cur_keyEvents')} AS current_key_events",
        f"{csv_cell('cur_totalUsers')} AS current_total_users")


def daily_csv(days: DataFrame, metrics: list[str]) -> DataFrame:
    """Every calendar day with its cells and whether the source returned it."""
    return days.selectExpr(
        "property_id", "CAST(date AS STRING) AS date",
        "if(returned, 'yes', 'no') AS data_returned",
        *[f"{csv_cell(m)} AS {m}" for m in metrics])


def ecommerce_csv(funnel: DataFrame, channels: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Funnel steps, channel revenue and items in one table."""
    def rows(df, kind, label, *cells):
        names = ["current_value", "previous_value", "current_secondary", "previous_secondary"]
        return df.selectExpr("property_id", f"'{kind}' AS kind", f"{label} AS label",
                             *[f"{csv_cell(c)} AS {n}" for c, n in zip(cells, names)])

    out = rows(funnel, "funnel", "label", "current", "previous", "step_rate_current",
               "step_rate_previous").unionByName(
        rows(channels, "channel", "key", "cur_totalRevenue", "prev_totalRevenue",
             "cur_transactions", "prev_transactions"))
    if items is not None:
        out = out.unionByName(rows(items, "item", "key", "cur_itemRevenue", "prev_itemRevenue",
                                   "cur_itemsPurchased", "prev_itemsPurchased"))
    return out


def write_csv(df: DataFrame, path: str) -> bool:
    """Write unless there is nothing to write; says whether it did."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option(
        "escape", '"').csv(path)
    return True


def append_ledger(rows: DataFrame, path: str, run_id: str) -> None:
    """Append a run to the ledger table. A repeated run replaces all that it wrote before."""
    _replace_run(rows, path, run_id, ["client"], "parquet")


def _replace_run(df: DataFrame, path: str, run_id: str, partitions: list[str], kind: str) -> None:
    """Write the rows of a run in place of what an earlier attempt of it wrote, other runs untouched.

    The run has a folder of its own that is replaced as a whole, so a key that drops out of a repeated
    run leaves nothing behind.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).format(kind).save(f"{path}/run_id={run_id}")


def append_archive(rows: DataFrame, path: str, run_id: str) -> None:
    """Archive entries of a run by purchase month, `YYYYMM_MonthName`; the client stays a column."""
    _replace_run(rows.hint("rebalance", "folder"), path, run_id, ["folder"], "parquet")


def append_run_log(summary: DataFrame, path: str, run_id: str, channel: str = "",
                   posted: bool = False) -> None:
    """One JSON line per client and run."""
    _replace_run(run_log(summary, run_id, channel, posted).drop("run_id"), path, run_id, [], "json")


def append_review_list(rows: DataFrame, path: str, run_id: str) -> None:
    """The open questions of a run, one JSON line each."""
    _replace_run(rows, path, run_id, [], "json")


def run_log(summary: DataFrame, run_id: str, channel: str = "", posted: bool = False) -> DataFrame:
    return summary.select(
        F.lit(run_id).alias("run_id"), "client", F.lit(channel).alias("channel"),
        F.col("receipts").alias("receipts_logged"), F.col("flagged").alias("needs_review_count"),
        "message", F.lit(posted).alias("posted"))
