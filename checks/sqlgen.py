"""Fragments shared by the DuckDB twins of the registered queries."""

from __future__ import annotations


def rnd(expr: str, places: int = 0) -> str:
    scale = f"{10 ** places}.0::DOUBLE"
    if places == 0:
        return f"(round_even(CAST({expr} AS DOUBLE), 0) + 0.0::DOUBLE)"
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale} + 0.0::DOUBLE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def two(measures: dict[str, str]) -> str:
    parts = []
    for name, expr in measures.items():
        parts.append(f"CAST(sum(CASE WHEN in_current THEN {expr} END) AS DOUBLE) AS cur_{name}")
        parts.append(f"CAST(sum(CASE WHEN in_previous THEN {expr} END) AS DOUBLE) AS prev_{name}")
    parts.append("count(*) FILTER (in_current) AS cur_rows")
    parts.append("count(*) FILTER (in_previous) AS prev_rows")
    return ",\n    ".join(parts)


def std_chg(source: str, name: str = "chg", pct: float = 10.0) -> str:
    """Standard change over columns c, p, floor, better."""
    return f"""{name} AS (
  SELECT *, CASE WHEN c IS NULL AND p IS NULL THEN 'unavailable' WHEN c IS NULL OR p IS NULL THEN 'partial'
      ELSE 'available' END AS availability,
    CASE WHEN c IS NULL OR p IS NULL THEN 'n/a' WHEN p = 0 THEN CASE WHEN c = 0 THEN 'flat' ELSE 'up' END
      WHEN abs(absolute_change) < 1e-9 THEN 'flat' WHEN absolute_change > 0 THEN 'up' ELSE 'down' END AS direction,
    CASE WHEN c IS NULL OR p IS NULL THEN 'unknown' WHEN p = 0 THEN CASE WHEN c = 0 THEN 'flat' ELSE 'new' END
      WHEN abs(absolute_change) < 1e-9 THEN 'flat' WHEN better = 'context' THEN 'ambiguous'
      WHEN NOT material THEN 'flat'
      WHEN (better = 'higher') = (absolute_change > 0) THEN 'improved' ELSE 'declined' END AS verdict
  FROM (SELECT *, CASE WHEN c IS NULL OR p IS NULL THEN false WHEN p = 0 THEN c <> 0
      WHEN abs(absolute_change) < 1e-9 THEN false
      ELSE abs(percent_change) >= {pct} AND abs(absolute_change) >= floor END AS material
    FROM (SELECT *, c - p AS absolute_change,
        CASE WHEN p = 0 THEN CASE WHEN c = 0 THEN 0.0::DOUBLE END ELSE (c - p) / abs(p) * 100.0 END AS percent_change
      FROM {source}))
)"""


def search_chg(source: str, name: str = "chg") -> str:
    """Search change over columns c, p, floor, better; figures unrounded, round when selecting."""
    return f"""{name} AS (
  SELECT *, CASE WHEN availability = 'unavailable' THEN 'unknown'
      WHEN (p IS NULL OR p = 0) AND c IS NOT NULL AND c <> 0 THEN 'new'
      WHEN availability = 'partial' THEN 'unknown' WHEN NOT material THEN 'flat'
      WHEN (better = 'higher') = (raw_abs > 0) THEN 'improved' ELSE 'declined' END AS verdict,
    {rnd('raw_abs', 4)} AS absolute_change, {rnd('raw_pct', 2)} AS percent_change,
    {rnd('c', 4)} AS cur4, {rnd('p', 4)} AS prev4
  FROM (SELECT *, CASE WHEN c IS NULL AND p IS NULL THEN 'unavailable' WHEN c IS NULL OR p IS NULL THEN 'partial'
        ELSE 'available' END AS availability,
      CASE WHEN raw_abs IS NULL THEN 'n/a' WHEN abs(raw_abs) < 1e-12 THEN 'flat' WHEN raw_abs > 0 THEN 'up' ELSE 'down' END AS direction,
      coalesce(abs(raw_abs) >= floor AND (raw_pct IS NULL OR abs(raw_pct) >= 5) AND abs(raw_abs) >= 1e-12, false) AS material
    FROM (SELECT *, c - p AS raw_abs, (c - p) / nullif(abs(p), 0) * 100.0 AS raw_pct FROM {source}))
)"""


def unpivot(source: str, keys: str, specs: list[tuple], name: str = "kl") -> str:
    """specs: (key, label, unit, better, floor[, column])."""
    rows = []
    for i, spec in enumerate(specs, start=1):
        key, label, unit, better, floor = spec[:5]
        column = spec[5] if len(spec) > 5 else key
        rows.append(
            f"SELECT {keys}, {i} AS position, '{key}' AS key, '{label}' AS label, '{unit}' AS unit, "
            f"'{better}' AS better, {float(floor)}::DOUBLE AS floor, CAST(cur_{column} AS DOUBLE) AS c, "
            f"CAST(prev_{column} AS DOUBLE) AS p FROM {source}"
        )
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(rows) + "\n)"


def pivot(source: str, keys: str, names: list[str], name: str = "kw") -> str:
    """One row per key group with <kpi>_<field> columns."""
    fields = {"cur": "c", "prev": "p", "abs": "absolute_change", "pct": "percent_change",
              "dir": "direction", "verdict": "verdict", "material": "material", "avail": "availability"}
    cols = []
    for kpi in names:
        for short, column in fields.items():
            cols.append(f"max(CASE WHEN key = '{kpi}' THEN {column} END) AS {kpi}_{short}")
    return f"{name} AS (SELECT {keys}, " + ",\n    ".join(cols) + f"\n  FROM {source} GROUP BY {keys})"


def findings(source: str, rules: list[tuple], keys: str = "property_id") -> str:
    """rules: (condition, id, type, severity, confidence, scope, entity) as SQL expressions."""
    parts = [
        f"SELECT {keys}, {i} AS id, {t} AS type, {s} AS severity, {c} AS confidence, {sc} AS scope, "
        f"{e} AS entity FROM {source} WHERE {cond}"
        for cond, i, t, s, c, sc, e in rules
    ]
    return "\n  UNION ALL ".join(parts)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)
