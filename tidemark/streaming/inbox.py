"""Receipts as they arrive: each micro-batch is filed against the ledger, repeats change nothing.

The ledger is kept twice: by run, for readers, and by the keys that find a duplicate. A row lies in
the bucket of its receipt number and in that of its date and amount, so a micro-batch reads the
buckets of its own keys and no others, however long the ledger is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import AMOUNT_KEY, NUMBER_KEY, file_batch, with_match_keys
from ..session import staging_scope

LEDGER = ("client string, merchant string, receipt_number string, purchase_date date, "
          "gross_amount decimal(18,2), line bigint, run_id string")
BY_KEY = LEDGER + ", kind string, bucket int"
# Folders per kind of key; more of them suit a longer ledger and fewer, larger batches.
KEY_BUCKETS = 64


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_ledger_table(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table so far; empty before the first run."""
    return _read(spark, LEDGER, path)


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Every row once for each of its match keys, with the kind and bucket of the key. A row without a
    number is found by its date and amount only."""
    def bucket(key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    # Hashes are taken of the ledger's own types.
    keyed = with_match_keys(rows).withColumns({
        "purchase_date": F.col("purchase_date").cast("date"), "gross_amount": F.col("gross_amount").cast("decimal(18,2)")})
    places = F.array(
        F.struct(F.lit("number").alias("kind"), F.when(F.col("number_key").isNotNull(), bucket(NUMBER_KEY)).alias("bucket")),
        F.struct(F.lit("amount").alias("kind"), bucket(AMOUNT_KEY).alias("bucket")))
    return keyed.select(*rows.columns, F.inline(places)).filter("bucket IS NOT NULL")


def write_keys(rows: DataFrame, path: str, buckets: int = KEY_BUCKETS) -> None:
    """Add ledger rows of a run to the table by key. Writing a run again replaces its files."""
    placed = _in_buckets(rows, buckets)
    placed.repartition("kind", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "kind", "bucket", "run_id").parquet(path)


def ensure_keys(spark: SparkSession, ledger_path: str, keys_path: str, buckets: int = KEY_BUCKETS) -> None:
    """Build the table by key of a ledger that was kept without one."""
    ledger = read_ledger_table(spark, ledger_path)
    if _read(spark, BY_KEY, keys_path).isEmpty() and not ledger.isEmpty():
        write_keys(ledger, keys_path, buckets)


def read_matching(batch: DataFrame, path: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Ledger rows that share a bucket with a row of the batch: all that can match one, and some more.

    The buckets of a batch are at most twice `buckets` pairs; as literals they prune the folders when the
    query is planned.
    """
    spark = batch.sparkSession
    wanted: dict[str, list[int]] = {"number": [], "amount": []}
    for row in _in_buckets(batch.select(*{*NUMBER_KEY, *AMOUNT_KEY} - {"merchant_key", "number_key"}, "merchant", "receipt_number"), buckets).select(
            "kind", "bucket").distinct().collect():
        wanted[row.kind].append(row.bucket)
    table = _read(spark, BY_KEY, path)
    hit = F.lit(False)
    for kind, numbers in wanted.items():
        if numbers:
            hit = hit | ((F.col("kind") == kind) & F.col("bucket").isin(sorted(numbers)))
    return table.filter(hit).drop("kind", "bucket")


def file_arrivals(batch: DataFrame, batch_id: int, ledger_path: str, keys_path: str | None = None, buckets: int = KEY_BUCKETS) -> None:
    """File one micro-batch. Its rows form their own partition, so a replay overwrites itself.

    The ledger that a replay compares with leaves out the partitions of the batch itself. Arrivals are
    written once, with the columns of the ledger only, and the table by key is made from the filed rows
    as the ledger holds them.
    """
    spark = batch.sparkSession
    keys_path = keys_path or f"{ledger_path.rstrip('/')}-by-key"
    run_id = f"batch-{batch_id:09d}"
    ensure_keys(spark, ledger_path, keys_path, buckets)
    with staging_scope(spark):
        arrived = batch.select(
            "client", "merchant", "receipt_number", "purchase_date", "gross_amount", "seq",
            F.lit(False).alias("force"), F.lit("").alias("review_notes"))
        filed = file_batch(arrived, lambda rows: read_matching(rows, keys_path, buckets).filter(F.col("run_id") != run_id))
        written = filed.filter("state = 'written'").select(
            "client", "merchant", "receipt_number", "purchase_date", "gross_amount",
            F.col("seq").alias("line"), F.lit(run_id).alias("run_id"))
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_id").parquet(ledger_path)
        write_keys(_read(spark, written.schema, ledger_path).filter(F.col("run_id") == run_id), keys_path, buckets)


def start(
    arrivals: DataFrame, ledger_path: str, checkpoint: str, event_time: str = "arrived_at",
    keep: str = "30 days", trigger: dict | None = None,
) -> StreamingQuery:
    """Drop rows seen within the watermark, then file what is left.

    `arrivals` has client, merchant, receipt_number, purchase_date, gross_amount, source_path, a
    unique rising `seq` and an event time. `trigger` is as for `DataStreamWriter.trigger`; by default
    what has arrived is filed and the query ends.
    """
    unseen = arrivals.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(
        ["client", "source_path"])
    return (
        unseen.writeStream.foreachBatch(lambda df, n: file_arrivals(df, n, ledger_path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
