"""Windows, spread joins, medians and daily series against plain Python."""

import random
import statistics
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, day_partials, periods, timeseries, user_bitmaps, web
from tidemark.operators.periods import Windows


def test_windows():
    w = periods.adjacent(date(2026, 8, 18), 30, lag_days=2)
    assert (w.cur_start, w.cur_end) == (date(2026, 7, 18), date(2026, 8, 16))
    assert (w.prev_start, w.prev_end) == (date(2026, 6, 18), date(2026, 7, 17))
    inferred = periods.explicit((date(2026, 1, 11), date(2026, 1, 20)), infer_previous=True)
    assert (inferred.prev_start, inferred.prev_end) == (date(2026, 1, 1), date(2026, 1, 10))
    with pytest.raises(ValueError):
        periods.explicit((date(2026, 1, 2), date(2026, 1, 1)), (date(2026, 1, 1), date(2026, 1, 1)))
    with pytest.raises(ValueError):
        periods.explicit((date(2026, 1, 1), date(2026, 1, 2)))


def test_period_flags(spark):
    df = spark.createDataFrame(
        [("same", date(2026, 2, 1), date(2026, 2, 10), date(2026, 1, 22), date(2026, 1, 31), date(2026, 3, 1)),
         ("odd", date(2026, 2, 1), date(2026, 2, 10), date(2026, 1, 30), date(2026, 2, 1), date(2026, 2, 10)),
         ("old", date(2024, 2, 1), date(2024, 2, 2), date(2024, 1, 30), date(2024, 1, 31), date(2026, 2, 10))],
        "property_id string, cur_start date, cur_end date, prev_start date, prev_end date, today date")
    got = {r["property_id"]: (r["comparable"], r["overlapping"], r["partial_today"], r["beyond_retention"])
           for r in periods.with_period_flags(df).collect()}
    assert got == {"same": (True, False, False, False), "odd": (False, True, True, False), "old": (True, False, False, True)}


def test_overlapping_windows_count_a_day_twice(spark):
    rows = spark.createDataFrame([("a", date(2026, 1, 5), 7)], "property_id string, date date, x int")
    w = Windows(date(2026, 1, 5), date(2026, 1, 6), date(2026, 1, 4), date(2026, 1, 5))
    row = aggregate.two_period(periods.mark(rows, w), ["property_id"], {"x": F.col("x")}).first()
    assert (row["cur_x"], row["prev_x"]) == (7, 7)


def test_sum_of_nothing_is_null(spark):
    rows = spark.createDataFrame([("a", True, False, None), ("a", False, True, 0)],
                                 "property_id string, in_current boolean, in_previous boolean, x int")
    row = aggregate.two_period(rows, ["property_id"], {"x": F.col("x")}).first()
    assert row["cur_x"] is None and row["prev_x"] == 0


def test_attach_equals_a_plain_join(spark):
    rows = spark.range(5000).selectExpr("id AS k", "IF(id % 3 = 0, 'hot', concat('p', id % 40)) AS property_id")
    small = rows.select("property_id").distinct().withColumn("v", F.hash("property_id")).filter("property_id <> 'p1'")
    plain = rows.join(small, "property_id", "left").select("k", "v")
    spread = aggregate.attach(rows, small, ["property_id"], ["k"], salts=7).select("k", "v")
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))


def test_numbered_equals_row_number(spark):
    rows = spark.range(3000).selectExpr("id * 7 AS seq", "IF(id % 3 = 0, 'hot', concat('k', id % 11)) AS k")
    got = {r["seq"]: r["n"] for r in aggregate.numbered(rows, ["k"], "seq", "n", width=500).collect()}
    seen, want = defaultdict(int), {}
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        seen[r["k"]] += 1
        want[r["seq"]] = seen[r["k"]]
    assert got == want


@pytest.mark.parametrize("most", [None, 1_000_000, 10])
def test_exact_median(spark, most):
    rng = random.Random(7)
    data = [(rng.choice("aaaaaabc"), rng.choice([rng.random() * 20, rng.gauss(0, 1e-9), 5.0])) for _ in range(3000)] + [("one", 4.25), ("one", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["median"], r["rows"]) for r in aggregate.exact_median(df, ["k"], "v", most=most).collect()}
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    assert got == {k: (statistics.median(v), len(v)) for k, v in groups.items()}
    assert aggregate.exact_median(df.limit(0), ["k"], "v", most=most).count() == 0


def test_users_of_any_days_from_bitmaps(spark):
    rng = random.Random(9)
    day = date(2026, 1, 1)
    rows = [("p", rng.randrange(70_000) if rng.random() < 0.7 else rng.randrange(50), day + timedelta(days=rng.randrange(20)), rng.choice("ab"), rng.random() < 0.5,
             rng.randrange(2), rng.randrange(2)) for _ in range(4000)]
    sessions = spark.createDataFrame(rows, "property_id string, user_id bigint, date date, channel string, engaged boolean, key_events int, purchases int").withColumns(
        {"first_seen": F.lit(day), "first_purchase": F.lit(None).cast("date")})
    old = user_bitmaps.user_numbers(sessions.filter("date < DATE '2026-01-08'"))
    numbers = user_bitmaps.user_numbers(sessions, old).cache()
    assert numbers.agg(F.max("number")).first()[0] == numbers.count() == len({r[1] for r in rows})
    assert old.join(numbers, ["property_id", "user_id", "number"], "left_anti").count() == 0
    pieces = user_bitmaps.day_bitmaps(sessions, numbers, {"channel": "channel"})
    windows = {"x": (day, day), "y": (day + timedelta(days=3), day + timedelta(days=9)), "z": (day, day + timedelta(days=30))}
    got = {(r.key, r.window): r for r in user_bitmaps.distinct_users(pieces, windows).collect()}
    for (key, name), r in got.items():
        mine = [x for x in rows if x[3] == key and windows[name][0] <= x[2] <= windows[name][1]]
        assert r.totalUsers == len({x[1] for x in mine}) and r.activeUsers == len({x[1] for x in mine if x[4]})
        assert r.totalPurchasers == len({x[1] for x in mine if x[6]}) and r.newUsers == len({x[1] for x in mine if x[2] == day}) and r.firstTimePurchasers == 0
    assert len(got) == 6
    weeks = user_bitmaps.merged(pieces, ["property_id"]).groupBy("figure").agg(F.sum(F.expr("bitmap_count(users)")).alias("n")).collect()
    assert {r.figure: r.n for r in weeks}["totalUsers"] == len({x[1] for x in rows})


def test_day_sums_read_what_is_new(spark, tmp_path):
    path, day = str(tmp_path / "sums"), date(2026, 1, 1)

    def facts(last, late=0):
        rows = [("p", k, day + timedelta(days=d), None if k == 2 else 10 * d + k + (late if d > 5 else 0)) for d in range(last + 1) for k in (1, 2, 3) if (d, k) != (7, 3) or not late]
        return spark.createDataFrame(rows, "property_id string, k int, date date, v bigint")

    measures, windows = {"v": F.col("v")}, Windows(day + timedelta(days=6), day + timedelta(days=9), day + timedelta(days=1), day + timedelta(days=5))

    def compared():
        out = day_partials.compared(day_partials.read(spark, path), windows, ["property_id", "k"], ["v"])
        return sorted(tuple(r[c] for c in ("k", "cur_v", "prev_v", "cur_rows", "prev_rows")) for r in out.collect())

    def direct(rows):
        out = aggregate.two_period(periods.mark(rows, windows), ["property_id", "k"], measures)
        return sorted(tuple(r[c] for c in ("k", "cur_v", "prev_v", "cur_rows", "prev_rows")) for r in out.collect())

    day_partials.refresh(facts(8), path, ["property_id", "k"], measures, day + timedelta(days=5))
    assert compared() == direct(facts(8))
    # Days that were not final have changed, and one has lost a key; final ones are not looked at again.
    wrong = facts(9, late=5).withColumn("v", F.expr("IF(date <= DATE '2026-01-06', -1000, v)"))
    day_partials.refresh(wrong, path, ["property_id", "k"], measures, day + timedelta(days=8))
    assert compared() == direct(facts(9, late=5))
    assert day_partials.final_through(spark, path) == day + timedelta(days=8)
    stored = str(tmp_path / "facts")
    facts(10).write.parquet(stored)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = day_partials.facts_to_read(spark.read.parquet(stored), day_partials.final_through(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(date,2026-01-09)" in plan.split("PushedFilters: [")[1]
    read = day_partials.compared(day_partials.read(spark, path), windows, ["property_id", "k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and "day" in read.split("PartitionFilters: [")[1].split("]")[0]


def series(spark, values, name, start=date(2026, 1, 5)):
    rows = [("p", start + timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"property_id string, date date, {name} double")


def test_halves_treat_odd_days_differently(spark):
    values = [10.0] * 7 + [100.0] + [20.0] * 7
    drift = timeseries.drift(series(spark, values, "sessions")).first()["drift"]
    assert drift == pytest.approx(((100 + 140) / 8) / 10 - 1)
    shape = timeseries.shape(series(spark, values, "clicks")).first()
    assert (shape["first_half"], shape["second_half"], shape["change_pct"], shape["trend"]) == (70, 140, 100.0, "rising")
    assert timeseries.drift(series(spark, values[:13], "sessions")).isEmpty()
    assert timeseries.drift(series(spark, [0.0] * 14, "sessions")).isEmpty()


def test_anomalies(spark):
    rng = random.Random(1)
    values = [100.0 + rng.randint(-3, 3) for _ in range(20)]
    values[11] = 400.0
    found = timeseries.web_anomalies(series(spark, values, "sessions"), ["sessions"]).collect()
    assert [(r["date"], r["direction"]) for r in found] == [(date(2026, 1, 16), "spike")]
    days = series(spark, values, "clicks").withColumn("impressions", F.col("clicks") * 10)
    both = timeseries.search_anomalies(days).collect()
    assert {(r["metric"], r["confidence"]) for r in both} == {("clicks", "high"), ("impressions", "high")}
    assert timeseries.web_anomalies(series(spark, [5.0] * 20, "sessions"), ["sessions"]).isEmpty()


def test_missing_days_and_calendar(spark):
    w = Windows(date(2026, 1, 5), date(2026, 1, 9), date(2025, 12, 31), date(2026, 1, 4))
    days = periods.calendar(w, spark.createDataFrame([("p",)], "property_id string"))
    assert days.count() == 10
    seen = series(spark, [1.0, 2.0], "sessions")
    gone = sorted(r["date"].day for r in timeseries.missing_days(days, seen).collect())
    assert gone == [7, 8, 9]


def test_flat_sparkline_stays_mid(spark):
    s = series(spark, [5.0, 5.0, 5.0], "sessions")
    got = timeseries.sparkline(timeseries.daily_series(s, ["sessions"])).collect()
    assert {r["y"] for r in got} == {13.0}
    assert timeseries.daily_series(series(spark, [1.0, 2.0], "sessions"), ["sessions"]).isEmpty()


def test_sessions_match_brute_force(spark):
    rng = random.Random(3)
    from datetime import datetime
    events, t0 = [], datetime(2026, 1, 1)
    for i in range(1500):
        user = 1 if rng.random() < 0.4 else rng.randint(2, 30)
        events.append((i, "p", user, t0 + timedelta(seconds=rng.randint(0, 300000))))
    df = spark.createDataFrame(events, "event_id int, property_id string, user_id int, ts timestamp_ntz").withColumns({
        "channel": F.lit("c"), "device": F.lit("d"), "page": F.lit("/"), "country": F.lit("x"), "event_name": F.lit("view"),
        "is_key": F.lit(False), "revenue": F.lit(0).cast("decimal(18,2)")})
    got = sorted((r["user_id"], r["started"], r["events"]) for r in web.sessionize(df).collect())
    want, per = [], defaultdict(list)
    for _, _, user, ts in events:
        per[user].append(ts)
    for user, stamps in per.items():
        stamps.sort()
        start, last, n = stamps[0], stamps[0], 1
        for ts in stamps[1:]:
            if ts - last > timedelta(minutes=30):
                want.append((user, start, n))
                start, n = ts, 0
            n, last = n + 1, ts
        want.append((user, start, n))
    assert got == sorted(want)


def test_ranked_all_equals_row_number(spark):
    rows = spark.range(2000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('k', id % 7)) AS k", "id * 37 % 11 AS a", "CAST(id AS STRING) AS b")
    got = {(r["k"], r["b"]): r["n"] for r in aggregate.ranked_all(rows, ["k"], ["a", "b"], "n").collect()}
    want, seen = {}, defaultdict(int)
    for r in sorted(rows.collect(), key=lambda r: (r["k"], r["a"], r["b"])):
        seen[r["k"]] += 1
        want[(r["k"], r["b"])] = seen[r["k"]]
    assert got == want


def test_windows_per_property(spark):
    rows = spark.range(400).selectExpr("concat('p', id % 4) AS property_id", "date_add(DATE '2026-01-01', CAST(id % 50 AS INT)) AS date", "id")
    windows = {f"p{i}": (date(2026, 1, 20 + i), date(2026, 1, 29 + (i > 0)), date(2026, 1, 10), date(2026, 1, 19)) for i in range(3)}
    frame = spark.createDataFrame([(k, *v) for k, v in windows.items()], "property_id string, cur_start date, cur_end date, prev_start date, prev_end date")
    got = {r["id"]: (r["in_current"], r["in_previous"]) for r in periods.mark(rows, frame).collect()}
    want = {}
    for r in rows.collect():
        if r["property_id"] in windows:
            a, b, c, d = windows[r["property_id"]]
            flags = a <= r["date"] <= b, c <= r["date"] <= d
            if any(flags):
                want[r["id"]] = flags
    assert got == want and want
