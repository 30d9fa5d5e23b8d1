from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.sources import envelopes, exports


def test_event_cells(spark):
    events = spark.createDataFrame(
        [("p", "signup", True, 120.0, None, 5, 40, 1), ("p", "late", False, 1.0, 1.5, 0, 1, 61)],
        "property_id string, event_name string, is_key_event boolean, cur_eventCount double, prev_eventCount double, "
        "cur_keyEvents bigint, cur_totalUsers bigint, rank int")
    rows = exports.events_csv(events).collect()
    assert sorted(tuple(r) for r in rows) == [("p", "late", "no", "1", "1.5000", "0", "1"), ("p", "signup", "yes", "120", "", "5", "40")]


def test_documents_hold_every_item(spark, tmp_path):
    kpis = spark.createDataFrame([("p", "cost", 1.0), ("q", "cost", 2.0)], "property_id string, key string, current double")
    found = spark.range(250).selectExpr("'p' AS property_id", "concat('f', id) AS id", "'high' AS severity")
    actions = spark.range(130).selectExpr("'p' AS property_id", "concat('f', id) AS from_finding", "'act' AS action", "0 AS priority_rank")
    for _ in range(2):  # a repeated run changes nothing
        exports.write_analysis(exports.analysis_documents(kpis, found, actions, "2026-03-31"), str(tmp_path / "d"))
    back = spark.read.json(str(tmp_path / "d"))
    assert {(r["property_id"], r["kind"]): r["count"] for r in back.groupBy("property_id", "kind").count().collect()} == {
        ("p", "kpi"): 1, ("q", "kpi"): 1, ("p", "finding"): 250, ("p", "recommended_action"): 130}
    assert back.filter("kind = 'kpi' AND property_id = 'q'").select(F.get_json_object("item", "$.current")).first()[0] == "2.0"


def test_nothing_is_written_for_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("Nando's, Cardiff", "", 1)], "a string, b string, n int")
    assert exports.write_csv(df, str(tmp_path / "full"))
    assert not exports.write_csv(df.filter("n = 2"), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "full")).first()
    assert back["a"] == "Nando's, Cardiff" and not back["b"]


def test_archive_and_run_log(spark, tmp_path):
    rows = spark.createDataFrame([("c", date(2026, 3, 14), "x.jpg")], "client string, purchase_date date, file_path string")
    for _ in range(2):
        exports.append_archive(rows.withColumn("folder", text.archive_folder(F.col("purchase_date"))), str(tmp_path / "a"), "r1")
    assert (tmp_path / "a" / "run_id=r1" / "folder=202603_March").is_dir()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1
    summary = spark.createDataFrame([("c", 3, 1, "3 receipts")], "client string, receipts int, flagged int, message string")
    for run in ("r1", "r2", "r2"):
        exports.append_run_log(summary, str(tmp_path / "log"), run, "C01", True)
    assert sorted(r["run_id"] for r in spark.read.json(str(tmp_path / "log")).collect()) == ["r1", "r2"]


def test_labels_and_ranges(spark):
    row = spark.range(1).select(
        text.compound_key(F.lit("news"), F.lit("organic")).alias("k"),
        dates.display_range(F.lit(date(2026, 7, 20)), F.lit(date(2026, 8, 18))).alias("r")).first()
    assert (row["k"], row["r"]) == ("news / organic", "Jul 20, 2026 – Aug 18, 2026")
    daily = spark.createDataFrame([(["20260720"],), (["(other)"],), ([],)], "keys array<string>")
    assert [r["date"] for r in envelopes.web_daily(daily).collect()] == ["2026-07-20", "(other)", None]


def test_scoped_tables_are_removed(spark):
    from tidemark.session import stage, staging_scope
    import os
    with staging_scope(spark) as path:
        assert stage(spark.range(3), "three").count() == 3
        assert os.path.isdir(path)
    assert not os.path.exists(path)
