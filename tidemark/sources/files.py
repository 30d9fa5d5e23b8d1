"""Ledger CSV, file inventories and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import LEDGER_COLUMNS
from ..functions.text import open_as

LEDGER_SCHEMA = (
    "merchant string, purchase_date date, currency string, gross_amount decimal(18,2), "
    "tax_amount decimal(18,2), net_amount decimal(18,2), receipt_number string, category string, "
    "confidence decimal(3,2), needs_review string, review_notes string, file_path string, "
    "processed_at timestamp_ntz"
)


def check_header(spark: SparkSession, path: str) -> None:
    """Refuse a ledger whose header is not the expected one, in name and order."""
    found = spark.read.option("header", True).option("escape", '"').csv(path).columns
    if found and found != LEDGER_COLUMNS:
        raise ValueError(f"ledger header differs: found {found}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    check_header(spark, path)
    rows = spark.read.schema(LEDGER_SCHEMA).option("header", True).option(
        "escape", '"').option("enforceSchema", False).csv(path)
    return rows.withColumn("needs_review", F.lower(F.trim("needs_review")) == "yes")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder except the processed subtree; contents are never read.

    Hidden files are listed and marked. No extension is filtered: the folder is the filter.
    """
    # `content` is not selected, so the source lists files without opening them.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return mark_files(listed.select("path", "length", "modificationTime"))


def mark_files(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.filter(~F.col("path").contains("/_processed-receipts/")).withColumns({
        "name": name, "hidden": name.startswith("."), "open_as": open_as(F.col("path"))})


def category_list(lines: DataFrame) -> DataFrame:
    """Categories from the rows of a markdown table: the first cell, in backticks."""
    cell = F.regexp_extract("value", r"^\|\s*`([^`]+)`\s*\|", 1)
    return lines.withColumn("category", cell).filter("category <> ''").drop("value")


def vendor_list(lines: DataFrame) -> DataFrame:
    """Vendor names from list items or bare lines; headings and blank lines do not count."""
    text = F.trim(F.regexp_replace("value", r"^\s*[-*+]\s+", ""))
    return lines.filter(~F.col("value").rlike(r"^\s*(#|$|>)")).withColumn(
        "vendor", text).filter("vendor <> ''").drop("value")
