import random
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark.operators import aggregate
from tidemark.streaming import events, inbox

EVENT = "property_id string, user_id int, ts timestamp_ntz, event_name string, is_key boolean, revenue decimal(18,2)"


def event(day, hour, user=1, name="view"):
    return ("p", user, datetime(2026, 3, day, hour), name, name == "purchase", Decimal(0))


def feed(spark, folder, rows, number):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder / f"in/part={number}"))


def test_days_come_out_once_final_and_late_rows_do_not_reopen_them(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.schema(EVENT + ", part int").option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).drop("part")
        q = (events.finalised_days(stream, "1 day").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted((r["date"].day, r["event_count"]) for r in spark.read.parquet(out).collect())

    feed(spark, tmp_path, [event(1, 5), event(1, 6), event(2, 5), event(4, 5)], 1)
    assert run() == [(1, 2), (2, 1)]
    feed(spark, tmp_path, [event(1, 9), event(4, 7), event(6, 1)], 2)
    assert run() == [(1, 2), (2, 1), (4, 2)]


def test_inbox_repeats_change_nothing(spark, tmp_path):
    schema = ("client string, merchant string, receipt_number string, purchase_date date, gross_amount decimal(18,2), "
              "source_path string, seq bigint, arrived_at timestamp")
    ledger = str(tmp_path / "ledger")

    def arrive(rows, n):
        spark.createDataFrame([("c", m, num, date(2026, 3, d), Decimal(g), p, s, datetime(2026, 3, 20, s)) for m, num, d, g, p, s in rows],
                              schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/run{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        inbox.start(stream, ledger, str(tmp_path / "cp")).awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(ledger).collect())

    assert arrive([("Shell", "A1", 1, 5, "a.jpg", 1), ("Shell", "A1", 2, 6, "b.jpg", 2), ("Cafe", "", 1, 7, "c.jpg", 3)], 1) == [1, 3]
    # The same file again, a duplicate of a booked row, and one that is new.
    assert arrive([("Cafe", "", 1, 7, "c.jpg", 4), ("cafe", "", 1, 7, "d.jpg", 5), ("Cafe", "", 3, 7, "e.jpg", 6)], 2) == [1, 3, 6]
    batch = spark.createDataFrame([("c", "Cafe", "", date(2026, 3, 3), Decimal(7), "e.jpg", 6)],
                                  "client string, merchant string, receipt_number string, purchase_date date, gross_amount decimal(18,2), source_path string, seq bigint")
    inbox.file_arrivals(batch, 1, ledger)  # a replay of the second micro-batch
    assert sorted(r["line"] for r in spark.read.parquet(ledger).collect()) == [1, 3, 6]


ARRIVAL = "client string, merchant string, receipt_number string, purchase_date date, gross_amount decimal(18,2), source_path string, seq bigint"


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    ledger, keys = str(tmp_path / "ledger"), str(tmp_path / "ledger-by-key")
    many = spark.range(2000).selectExpr(
        "'c' AS client", "concat('m', id % 50) AS merchant", "if(id % 3 = 0, '', concat('R', id)) AS receipt_number",
        "date_add(DATE '2026-01-01', CAST(id % 300 AS INT)) AS purchase_date", "CAST(id AS DECIMAL(18,2)) AS gross_amount",
        "concat('p', id) AS source_path", "id AS seq")
    inbox.file_arrivals(many, 0, ledger)
    batch = spark.createDataFrame([("c", "M7", "r7", date(2026, 5, 5), Decimal(1), "x", 5000), ("c", "m9", "", date(2026, 1, 10), Decimal(9), "y", 5001),
                                   ("c", "m1", None, date(2020, 1, 1), Decimal(3), "z", 5002)], ARRIVAL)
    found = inbox.read_matching(batch, keys)
    folders = {r[0].split("/run_id=")[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert len(folders) <= 4 and 0 < found.count() < 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    inbox.file_arrivals(batch, 1, ledger)
    assert sorted(r["line"] for r in inbox.read_ledger_table(spark, ledger).filter("line >= 5000").collect()) == [5002]
    # A ledger that was kept without the table by key gets it first.
    old = str(tmp_path / "old")
    inbox.read_ledger_table(spark, ledger).filter("line < 5000").write.partitionBy("run_id").parquet(old)
    inbox.file_arrivals(batch, 7, old)
    assert sorted(r["line"] for r in inbox.read_ledger_table(spark, old).filter("line >= 5000").collect()) == [5002]


def test_arrivals_without_look_alikes_join_no_keys(spark, tmp_path, monkeypatch):
    joined, write = [], aggregate.stage

    def counted(df, name, *more):
        kept = write(df, name, *more)
        joined.append(kept.count())
        return kept

    monkeypatch.setattr(aggregate, "stage", counted)
    rows = spark.range(300).selectExpr(
        "'c' AS client", "'m' AS merchant", "concat('R', id) AS receipt_number", "DATE '2026-01-01' AS purchase_date",
        "CAST(id AS DECIMAL(18,2)) AS gross_amount", "concat('p', id) AS source_path", "id AS seq")
    inbox.file_arrivals(rows, 0, str(tmp_path / "ledger"))
    assert inbox.read_ledger_table(spark, str(tmp_path / "ledger")).count() == 300
    assert joined and sum(joined) == 0


def test_an_arrival_is_written_once_before_it_is_filed(spark, tmp_path, monkeypatch):
    """Texts of the rows lie in the batch, the ledger and its table by key, and nowhere else."""
    tables, write = [], DataFrameWriter.parquet

    def noted(writer, path, *more, **options):
        write(writer, path, *more, **options)
        tables.append((path.rsplit("/", 1)[-1].split("-")[0], writer._df.columns))

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = spark.range(40).selectExpr(
        "'c' AS client", "'m' AS merchant", "concat('R', id % 30) AS receipt_number", "DATE '2026-01-01' AS purchase_date",
        "CAST(id AS DECIMAL(18,2)) AS gross_amount", "concat('p', id) AS source_path", "id AS seq")
    path = str(tmp_path / "ledger")
    inbox.file_arrivals(rows, 0, path)
    assert [name for name, columns in tables if "merchant" in columns] == ["batch", "ledger", "ledger"]
    assert not any("source_path" in columns for _, columns in tables)
    assert sorted(r.line for r in inbox.read_ledger_table(spark, path).collect()) == list(range(30))
    by_key = spark.read.parquet(f"{path}-by-key").collect()
    assert sorted((r.kind, r.line) for r in by_key) == [(kind, i) for kind in ("amount", "number") for i in range(30)]


def test_events_start_stop_and_come_back_over_restarts(spark, tmp_path):
    schema = "property_id string, event_name string, date date, event_count bigint"
    rng, quiet, rows = random.Random(3), 3, []
    for name in "abcdefgh":
        day = rng.randint(1, 6)
        while day < 60:
            rows.append(("p", name, date(2026, 1, 1) + timedelta(days=day), rng.randint(1, 9)))
            day += rng.choice([1, 1, 2, 3, 4, 5, 9])
    rows += [("q", "clock", date(2026, 1, 1) + timedelta(days=d), 1) for d in range(75)]
    source, out = str(tmp_path / "days"), str(tmp_path / "out")

    def run(first, last):
        part = [r for r in rows if first <= (r[2] - date(2026, 1, 1)).days < last]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = events.event_changes(spark.readStream.schema(schema).parquet(source), quiet)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for first, last in ((0, 7), (7, 8), (8, 30), (30, 75)):  # each run goes on from the checkpoint of the last
        run(first, last)
    want = []
    for key in {r[:2] for r in rows}:
        since, last, count = None, None, 0
        for _, _, day, n in sorted(r for r in rows if r[:2] == key):
            if last is not None and day > last + timedelta(days=quiet):
                want.append((*key, "stopped", last + timedelta(days=quiet), last, count))
                since, count = None, 0
            if since is None:
                want.append((*key, "started", day, last if count or last else None, 0))
                since = day
            last, count = day, count + n
        if date(2026, 1, 1) + timedelta(days=74) > last + timedelta(days=quiet + 2):
            want.append((*key, "stopped", last + timedelta(days=quiet), last, count))
    got = [tuple(r)[:4] + (r.event_count,) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(w[:4] + (w[5],) for w in want) and sum(w[2] == "stopped" for w in want) > 8
