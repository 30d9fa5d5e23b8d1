import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from tidemark.operators import web, web_history
from tidemark.operators.periods import Windows, flag

EVENT = ("property_id string, user_id bigint, event_id bigint, ts timestamp_ntz, date date, event_name string, is_key boolean, "
         "revenue decimal(18,2), channel string, device string, page string, country string")
WINDOWS = Windows(date(2026, 3, 9), date(2026, 3, 12), date(2026, 3, 5), date(2026, 3, 8))
FIELDS = ["property_id", "user_id", "started", "ended", "events", "purchases", "channel", "in_current", "in_previous"]


def events(spark, seed):
    """Many sessions around midnight, some of them over several days."""
    rng, rows = random.Random(seed), []
    for user in range(60):
        at = datetime(2026, 3, rng.randint(1, 12), rng.choice([0, 8, 22, 23]), rng.randrange(60))
        for _ in range(rng.randint(1, 40)):
            rows.append((rng.choice("pq") if user % 9 == 0 else "p", user, len(rows), at, at.date(), rng.choice(["view", "click", "purchase"]), rng.random() < 0.1,
                         Decimal(1), rng.choice(["a", "b", None]), "d", "/", "c"))
            at += timedelta(minutes=rng.choice([1, 29, 30, 31, 600, 1500] if user % 4 else [25, 30]))
    for k in range(200):  # one that goes on for days after the windows began it
        at = datetime(2026, 3, 12, 23, 50) + timedelta(minutes=30 * k)
        rows.append(("p", 99, len(rows), at, at.date(), "view", False, Decimal(0), "z", "d", "/", "c"))
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(("seed", "steps"), [(0, [12]), (1, [4, 5, 12]), (2, [1, 9, 10, 13])])
def test_equals_the_whole_history(spark, tmp_path, seed, steps):
    rows, path = events(spark, seed), str(tmp_path / "kept")
    for day in steps:
        web_history.keep(rows, path, date(2026, 3, day))
    web_history.keep(rows, path, date(2026, 3, steps[0]))  # nothing new
    want = flag(web.with_first_seen(web.sessionize(rows)), WINDOWS).filter("in_current OR in_previous")
    got = web_history.windowed_sessions(rows, WINDOWS, path)

    def plain(df):
        out = []
        for r in df.collect():
            new, bought = (d if d is not None and date(2026, 3, 5) <= d <= date(2026, 3, 12) else None for d in (r.first_seen, r.first_purchase))
            out.append((*(r[f] for f in FIELDS), new, bought, r.first_channel))
        return sorted(out, key=repr)

    assert plain(got) == plain(want) and got.count() > 30
    narrow = web_history.windowed_sessions(rows, WINDOWS, path, first_channel=False)
    keys = ["property_id"]
    assert sorted(web.breakdown(narrow, keys).collect()) == sorted(web.breakdown(want, keys).collect())


def test_bounds_reach_the_scan(spark, tmp_path):
    rows, path, source = events(spark, 3), str(tmp_path / "kept"), str(tmp_path / "events")
    rows.write.parquet(source)
    stored = spark.read.parquet(source)
    web_history.keep(stored, path, date(2026, 3, 12))
    seen = []
    original, length = web_history.sessionize, spark.conf.get("spark.sql.maxMetadataStringLength")
    web_history.sessionize = lambda df, *more: seen.append(df) or original(df, *more)
    try:
        web_history.windowed_sessions(stored, WINDOWS, path)
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        web_history.sessionize = original
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(date,2026-03-04)" in pushed and "GreaterThanOrEqual(ts,2026-03-04T23:30" in pushed and "LessThan(ts," in pushed
    assert len(seen) > 1  # the long session made it look further


def test_an_attempt_that_did_not_end_leaves_nothing(spark, tmp_path):
    rows, path = events(spark, 4), str(tmp_path / "kept")
    web_history.keep(rows, path, date(2026, 3, 6))
    kept = sorted(map(str, spark.read.parquet(f"{path}/users").collect()))
    web_history.keep(rows, path, date(2026, 3, 9))
    # As if the last step had not been reached: the days of that run do not count and are written anew.
    once = sorted(map(str, spark.read.parquet(f"{path}/users").collect()))
    through = spark.read.parquet(f"{path}/through").filter("through < DATE '2026-03-09'").collect()
    spark.createDataFrame(through, "through date").write.mode("overwrite").parquet(f"{path}/through")
    web_history.keep(rows, path, date(2026, 3, 9))
    assert sorted(map(str, spark.read.parquet(f"{path}/users").collect())) == once and len(once) > len(kept)


def test_windows_must_be_kept(spark, tmp_path):
    with pytest.raises(ValueError):
        web_history.windowed_sessions(events(spark, 5), WINDOWS, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        web_history.keep(events(spark, 5), str(tmp_path / "none"), date(2026, 3, 12), gap_minutes=1440)
