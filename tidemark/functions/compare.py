"""Change records: one metric, two periods, with direction and verdict kept apart.

Direction is arithmetic, verdict is a judgement. The two variants differ in their handling of
zero baselines, rounding and materiality and must not be merged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import ADS_MATERIAL_PCT, SEARCH_MATERIAL_PCT, Kpi
from .nulls import rnd_sql

FIELDS = [
    "current", "previous", "absolute_change", "percent_change", "availability", "direction",
    "verdict", "material", "notes",
]


def percent_change(current: Column, previous: Column) -> Column:
    """Null against a zero or missing baseline."""
    return F.try_divide(current - previous, F.abs(previous)) * F.lit(100.0)


class Change(NamedTuple):
    """What to compare: output column, SQL for both sides, unit and the better direction."""

    out: str
    current: str
    previous: str
    unit: str
    better: str
    floor: float | None = None


def _staged(df: DataFrame, items: list[Change], steps: list) -> DataFrame:
    """Add one struct column per item, computing its fields in successive projections.

    A later field reads earlier ones as plain columns. Written as one nested expression, every
    field would repeat all it depends on and the plan would grow with each use.
    """
    for step in steps:
        added = {}
        for item in items:
            own = {n: f"`{item.out}.{n}`" for n in (
                "current", "previous", "size", "percent", "availability", "from_zero", "is_new",
                "material", "direction", "verdict", "notes")}
            for name, sql in step(item, own).items():
                added[f"{item.out}.{name}"] = F.expr(sql)
        df = df.withColumns(added)
    return df


def _judge(better: str, direction: str) -> str:
    if better == "context":
        return "'ambiguous'"
    good = "up" if better == "higher" else "down"
    return f"if({direction} = '{good}', 'improved', 'declined')"


def _pack(df: DataFrame, items: list[Change], sources: dict[str, str]) -> DataFrame:
    structs = {}
    for item in items:
        fields = ", ".join(
            f"'{name}', {source.format(o=item.out)}" for name, source in sources.items()
        )
        structs[item.out] = F.expr(f"named_struct({fields})")
    packed = df.withColumns(structs)
    temporary = [c for c in packed.columns if any(c.startswith(i.out + ".") for i in items)]
    return packed.drop(*[F.col(f"`{c}`") for c in temporary])


def _sides(item: Change, _) -> dict[str, str]:
    return {
        "current": f"CAST({item.current} AS DOUBLE)",
        "previous": f"CAST({item.previous} AS DOUBLE)",
    }


def _sizes(item: Change, o) -> dict[str, str]:
    c, p = o["current"], o["previous"]
    return {
        "size": f"{c} - {p}",
        "percent": f"try_divide({c} - {p}, abs({p})) * 100.0D",
        "availability": (
            f"CASE WHEN {c} IS NULL AND {p} IS NULL THEN 'unavailable' "
            f"WHEN {c} IS NULL OR {p} IS NULL THEN 'partial' ELSE 'available' END"
        ),
        "from_zero": f"coalesce({p} = 0 AND {c} IS NOT NULL, false)",
        "is_new": f"coalesce(({p} IS NULL OR {p} = 0) AND {c} <> 0, false)",
    }


def standard_changes(
    df: DataFrame,
    items: list[Change],
    floors: dict[str, float],
    material_pct: float = ADS_MATERIAL_PCT,
) -> DataFrame:
    """The ads and web variant."""

    def moves(item: Change, o) -> dict[str, str]:
        floor = float(item.floor if item.floor is not None else floors.get(item.unit, 0.0))
        return {
            "material": (
                f"CASE WHEN {o['availability']} <> 'available' THEN false "
                f"WHEN {o['from_zero']} THEN {o['current']} <> 0 "
                f"WHEN abs({o['size']}) < 1e-9D THEN false "
                f"ELSE abs({o['percent']}) >= {float(material_pct)}D "
                f"AND abs({o['size']}) >= {floor}D END"
            ),
            "direction": (
                f"CASE WHEN {o['availability']} <> 'available' THEN 'n/a' "
                f"WHEN {o['from_zero']} THEN if({o['current']} = 0, 'flat', 'up') "
                f"WHEN abs({o['size']}) < 1e-9D THEN 'flat' "
                f"WHEN {o['size']} > 0 THEN 'up' ELSE 'down' END"
            ),
        }

    def verdicts(item: Change, o) -> dict[str, str]:
        moved = _judge(item.better, o["direction"])
        if item.better != "context":
            moved = f"if({o['material']}, {moved}, 'flat')"
        missing = f"{o['availability']} = 'partial'"
        compared = (f"{o['availability']} = 'available' AND NOT {o['from_zero']} "
                    f"AND {o['direction']} <> 'flat'")
        return {
            "verdict": (
                f"CASE WHEN {o['availability']} <> 'available' THEN 'unknown' "
                f"WHEN {o['direction']} = 'flat' THEN 'flat' "
                f"WHEN {o['from_zero']} THEN 'new' ELSE {moved} END"
            ),
            "notes": _notes([
                (f"{o['availability']} = 'unavailable'", "not reported for either period"),
                (f"{missing} AND {o['current']} IS NOT NULL",
                 "reported for the current period only"),
                (f"{missing} AND {o['previous']} IS NOT NULL",
                 "reported for the previous period only"),
                (f"{o['from_zero']} AND {o['current']} = 0", "zero in both periods"),
                (f"{o['from_zero']} AND {o['current']} <> 0",
                 "previous period was zero, percentage undefined"),
                (f"{compared} AND NOT {o['material']}", "below the materiality threshold"),
                (f"{compared} AND {str(item.better == 'context').lower()}",
                 "direction alone does not say whether this is good"),
            ]),
        }

    staged = _staged(df, items, [_sides, _sizes, moves, verdicts])
    sources = {f: f"`{{o}}.{f}`" for f in FIELDS}
    sources["absolute_change"] = "`{o}.size`"
    # Zero to zero is a known change of nothing here.
    sources["percent_change"] = (
        "if(`{o}.from_zero` AND `{o}.current` = 0, 0.0D, `{o}.percent`)"
    )
    return _pack(staged, items, sources)


def search_changes(
    df: DataFrame, items: list[Change], material_pct: float = SEARCH_MATERIAL_PCT
) -> DataFrame:
    """The search variant: a missing baseline counts as new and figures come out rounded."""

    def moves(item: Change, o) -> dict[str, str]:
        enough = "true" if item.floor is None else f"abs({o['size']}) >= {float(item.floor)}D"
        return {
            "material": (
                f"coalesce({enough} AND ({o['percent']} IS NULL "
                f"OR abs({o['percent']}) >= {float(material_pct)}D) "
                f"AND abs({o['size']}) >= 1e-12D, false)"
            ),
            "direction": (
                f"CASE WHEN {o['size']} IS NULL THEN 'n/a' "
                f"WHEN abs({o['size']}) < 1e-12D THEN 'flat' "
                f"WHEN {o['size']} > 0 THEN 'up' ELSE 'down' END"
            ),
        }

    def verdicts(item: Change, o) -> dict[str, str]:
        below = ("false" if item.floor is None
                 else f"abs({o['size']}) < {float(item.floor)}D")
        return {
            "verdict": (
                f"CASE WHEN {o['availability']} = 'unavailable' THEN 'unknown' "
                f"WHEN {o['is_new']} THEN 'new' "
                f"WHEN {o['availability']} = 'partial' THEN 'unknown' "
                f"WHEN NOT {o['material']} THEN 'flat' "
                f"ELSE {_judge(item.better, o['direction'])} END"
            ),
            "notes": _notes([
                (o["is_new"], "no baseline, only the absolute figure counts"),
                (below, "below the materiality floor"),
            ]),
        }

    staged = _staged(df, items, [_sides, _sizes, moves, verdicts])
    sources = {f: f"`{{o}}.{f}`" for f in FIELDS}
    sources["current"] = rnd_sql("`{o}.current`", 4)
    sources["previous"] = rnd_sql("`{o}.previous`", 4)
    sources["absolute_change"] = rnd_sql("`{o}.size`", 4)
    sources["percent_change"] = rnd_sql("`{o}.percent`", 2)
    return _pack(staged, items, sources)


def _notes(pairs: list[tuple[str, str]]) -> str:
    return "array_compact(array(" + ", ".join(
        f"CASE WHEN {cond} THEN '{text}' END" for cond, text in pairs
    ) + "))"


def kpi_changes(
    df: DataFrame, specs: list[Kpi], floors: dict[str, float], material_pct: float
) -> DataFrame:
    """One struct column `k_<key>` per KPI from columns `cur_<key>` and `prev_<key>`."""
    items = [
        Change(f"k_{k.key}", f"cur_{k.key}", f"prev_{k.key}", k.unit, k.better) for k in specs
    ]
    return standard_changes(df, items, floors, material_pct)


def long_kpis(wide: DataFrame, specs: list[Kpi], keys: list[str]) -> DataFrame:
    """Unpivot the `k_*` struct columns to one row per KPI."""
    rows = []
    for position, k in enumerate(specs, start=1):
        fields = ", ".join(f"k_{k.key}.{f} AS {f}" for f in FIELDS)
        rows.append(
            f"struct({position} AS position, '{k.key}' AS key, '{k.label}' AS label, "
            f"'{k.unit}' AS unit, '{k.better}' AS better_when, {fields})"
        )
    return wide.selectExpr(*keys, f"inline(array({', '.join(rows)}))")
