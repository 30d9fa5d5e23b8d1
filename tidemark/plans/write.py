"""Write a report: its tables as Parquet and one JSON document per property."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import exports


def write_report(report: dict[str, DataFrame], folder: str, period_end: str) -> None:
    """Tables in full; documents read the tables back instead of computing the report again."""
    for name, df in report.items():
        df.write.mode("overwrite").parquet(f"{folder}/tables/{name}")
    spark = report["kpis"].sparkSession
    tables = {n: spark.read.parquet(f"{folder}/tables/{n}")
              for n in ("kpis", "findings", "recommendations")}
    documents = exports.analysis_documents(
        tables["kpis"], tables["findings"], tables["recommendations"], period_end)
    exports.write_analysis(documents, f"{folder}/documents")
    exports.write_kpis(tables["kpis"], f"{folder}/kpis", period_end)
