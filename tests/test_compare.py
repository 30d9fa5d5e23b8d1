"""The truth table of both change variants, one handmade row per case."""

import pytest

from tidemark.functions.catalog import ADS_FLOORS
from tidemark.functions.compare import Change, search_changes, standard_changes

CASES = [
    # name, current, previous, unit, better
    ("both_missing", None, None, "int", "higher"),
    ("new_side", 310.0, None, "int", "higher"),
    ("lost_side", None, 310.0, "int", "higher"),
    ("zero_zero", 0.0, 0.0, "int", "higher"),
    ("from_zero", 22.0, 0.0, "int", "higher"),
    ("from_zero_down", -5.0, 0.0, "int", "higher"),
    ("position_better", 8.0, 12.0, "decimal", "lower"),
    ("position_worse", 9.0, 5.0, "decimal", "lower"),
    ("small_move", 13.0, 9.0, "int", "higher"),
    ("plain_gain", 120.0, 100.0, "int", "higher"),
    ("plain_gain_big", 150.0, 100.0, "int", "higher"),
    ("context_small", 101.0, 100.0, "currency", "context"),
    ("same", 100.0, 100.0, "int", "higher"),
]

STANDARD = {
    "both_missing": (None, "unavailable", "n/a", "unknown", False),
    "new_side": (None, "partial", "n/a", "unknown", False),
    "lost_side": (None, "partial", "n/a", "unknown", False),
    "zero_zero": (0.0, "available", "flat", "flat", False),
    "from_zero": (None, "available", "up", "new", True),
    "from_zero_down": (None, "available", "up", "new", True),
    "position_better": (-100 / 3, "available", "down", "improved", True),
    "position_worse": (80.0, "available", "up", "declined", True),
    "small_move": (400 / 9, "available", "up", "flat", False),
    "plain_gain": (20.0, "available", "up", "flat", False),
    "plain_gain_big": (50.0, "available", "up", "improved", True),
    "context_small": (1.0, "available", "up", "ambiguous", False),
    "same": (0.0, "available", "flat", "flat", False),
}
# Floor 10 throughout, positions 0.3.
SEARCH = {
    "both_missing": (None, "unavailable", "n/a", "unknown", False),
    "new_side": (None, "partial", "n/a", "new", False),
    "lost_side": (None, "partial", "n/a", "unknown", False),
    "zero_zero": (None, "available", "flat", "flat", False),
    "from_zero": (None, "available", "up", "new", True),
    "from_zero_down": (None, "available", "down", "new", False),
    "position_better": (-33.33, "available", "down", "improved", True),
    "position_worse": (80.0, "available", "up", "declined", True),
    "small_move": (44.44, "available", "up", "flat", False),
    "plain_gain": (20.0, "available", "up", "improved", True),
    "plain_gain_big": (50.0, "available", "up", "improved", True),
    "context_small": (1.0, "available", "up", "flat", False),
    "same": (0.0, "available", "flat", "flat", False),
}


def run(spark, apply):
    out = {}
    for name, c, p, unit, better in CASES:
        df = spark.createDataFrame([(c, p)], "c double, p double")
        out[name] = apply(df, name, unit, better).first()["rec"]
    return out


def seen(rec):
    return (rec["availability"], rec["direction"], rec["verdict"], rec["material"])


@pytest.fixture(scope="module")
def standard(spark):
    return run(spark, lambda df, n, u, b: standard_changes(
        df, [Change("rec", "c", "p", u, b)], ADS_FLOORS))


@pytest.fixture(scope="module")
def search(spark):
    return run(spark, lambda df, n, u, b: search_changes(
        df, [Change("rec", "c", "p", u, b, 0.3 if n.startswith("position") else 10.0)]))


@pytest.mark.parametrize("name", STANDARD)
def test_standard(standard, name):
    rec, want = standard[name], STANDARD[name]
    assert seen(rec) == want[1:]
    assert rec["percent_change"] == (None if want[0] is None else pytest.approx(want[0]))


@pytest.mark.parametrize("name", SEARCH)
def test_search(search, name):
    rec, want = search[name], SEARCH[name]
    assert seen(rec) == want[1:]
    assert rec["percent_change"] == (None if want[0] is None else pytest.approx(want[0]))


def test_notes(standard, search):
    assert standard["from_zero"]["notes"] == ["previous period was zero, percentage undefined"]
    assert "direction alone does not say whether this is good" in standard["context_small"]["notes"]
    assert search["small_move"]["notes"] == ["below the materiality floor"]
