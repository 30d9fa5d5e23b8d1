"""Figures as text: money, rates, durations, deltas and evidence lines.

The functions take and return SQL expression text, because rule tables splice dozens of them into
one projection; wrap a result in `F.expr` to use it as a column.
"""

from __future__ import annotations

from typing import NamedTuple

from .catalog import CURRENCY_SYMBOLS, LEDGER_SYMBOLS

NOT_AVAILABLE = "'not available'"


class Style(NamedTuple):
    """How one report shows rates, decimals and a change from zero."""

    rate_places: int
    decimals_by_size: bool
    from_zero: str


ADS_STYLE = Style(2, True, "n/a (from zero)")
WEB_STYLE = Style(1, False, "new (was zero)")
SEARCH_STYLE = Style(2, False, "n/a")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def grouped(value: str, places: int) -> str:
    """Thousands separators and fixed places, halves to even."""
    return f"format_number(CAST({value} AS DOUBLE), {places})"


def plain(value: str, places: int) -> str:
    return f"replace({grouped(value, places)}, ',', '')"


def by_size(value: str) -> str:
    """Fewer places for bigger or whole figures."""
    places = (f"CASE WHEN {value} = floor({value}) OR abs({value}) >= 100 THEN 0 "
              f"WHEN abs({value}) >= 10 THEN 1 ELSE 2 END")
    return f"format_number(CAST({value} AS DOUBLE), {places})"


def symbol_of(currency: str, symbols: dict[str, str] = CURRENCY_SYMBOLS) -> str:
    pairs = ", ".join(f"{quoted(code)}, {quoted(sign)}" for code, sign in symbols.items())
    return f"try_element_at(map({pairs}), upper({currency}))"


def money(value: str, currency: str = "''", places: int = 2) -> str:
    """`currency` is SQL text; a literal is resolved here so no map is built per row."""
    figure = grouped(value, places)
    if currency.startswith("'"):
        code = currency.strip("'").upper()
        sign = CURRENCY_SYMBOLS.get(code)
        shown = (f"concat({quoted(sign)}, {figure})" if sign
                 else f"concat({figure}, {quoted(' ' + code)})" if code else figure)
    else:
        sign = symbol_of(currency)
        shown = (f"coalesce(concat({sign}, {figure}), "
                 f"trim(concat_ws(' ', {figure}, {currency})))")
    return f"if({value} IS NULL, {NOT_AVAILABLE}, {shown})"


def ledger_amount(currency: str, total: str) -> str:
    figure = f"format_number({total}, 2)"
    sign = symbol_of(currency, LEDGER_SYMBOLS)
    return f"coalesce(concat({sign}, {figure}), concat_ws(' ', {figure}, upper({currency})))"


def compact_number(value: str) -> str:
    """48.2k, 1.2M, 3B; small figures in full."""
    def scaled(by: str, suffix: str) -> str:
        text = f"concat({plain(f'{value} / {by}', 1)}, '{suffix}')"
        return f"replace({text}, '.0{suffix}', '{suffix}')"

    return (
        f"CASE WHEN {value} IS NULL THEN {NOT_AVAILABLE} "
        f"WHEN abs({value}) >= 1e9 THEN {scaled('1e9D', 'B')} "
        f"WHEN abs({value}) >= 1e6 THEN {scaled('1e6D', 'M')} "
        f"WHEN abs({value}) >= 1e3 THEN {scaled('1e3D', 'k')} ELSE {grouped(value, 0)} END"
    )


def duration(seconds: str) -> str:
    """m:ss, and h:mm:ss past an hour."""
    total = f"abs(CAST(rint({seconds}) AS BIGINT))"
    sign = f"if(rint({seconds}) < 0, '-', '')"
    rest = f"lpad(CAST({total} % 60 AS STRING), 2, '0')"
    short = f"concat({sign}, CAST({total} div 60 AS STRING), ':', {rest})"
    long = (f"concat({sign}, CAST({total} div 3600 AS STRING), ':', "
            f"lpad(CAST(({total} % 3600) div 60 AS STRING), 2, '0'), ':', {rest})")
    return (f"if({seconds} IS NULL, {NOT_AVAILABLE}, "
            f"if({total} >= 3600, {long}, {short}))")


def whole_or_two(value: str) -> str:
    """No decimals for a whole figure, two for any other."""
    return (f"format_number(CAST({value} AS DOUBLE), "
            f"if(abs({value} - rint({value})) < 1e-6, 0, 2))")


def value_text(
    value: str, unit: str, currency: str = "''", style: Style = ADS_STYLE
) -> str:
    """A KPI figure by its unit."""
    shown = {
        "currency": lambda: money(value, currency),
        "rate": lambda: f"concat({grouped(value, style.rate_places)}, '%')",
        "int": lambda: grouped(value, 0),
        "duration": lambda: duration(value),
        "position": lambda: plain(value, 1),
    }.get(unit, lambda: (by_size if style.decimals_by_size else whole_or_two)(value))()
    return f"if({value} IS NULL, {NOT_AVAILABLE}, {shown})"


def signed(value: str, text: str) -> str:
    return f"concat(if({value} > 0, '+', ''), {text})"


def delta_text(
    change: str, unit: str, currency: str = "''", style: Style = ADS_STYLE
) -> str:
    """An absolute change in the metric's own unit, with a sign."""
    shown = {
        "rate": lambda: signed(change, f"concat({plain(change, style.rate_places)}, ' pp')"),
        "currency": lambda: (f"concat(if({change} > 0, '+', '-'), "
                             f"{money(f'abs({change})', currency)})"),
        "int": lambda: signed(change, grouped(change, 0)),
        "duration": lambda: signed(change, duration(change)),
        "position": lambda: signed(change, plain(change, 1)),
    }.get(unit, lambda: signed(
        change, grouped(change, 2) if style.decimals_by_size else whole_or_two(change)))()
    return f"if({change} IS NULL, 'n/a', {shown})"


def percent_text(percent: str, verdict: str = "''", style: Style = ADS_STYLE) -> str:
    shown = signed(percent, f"concat({plain(percent, 1)}, '%')")
    return (f"if({percent} IS NULL, if({verdict} = 'new', '{style.from_zero}', 'n/a'), {shown})")


def evidence_line(
    rec: str, label: str, unit: str, currency: str = "''", style: Style = ADS_STYLE
) -> str:
    """One factual line for a change record; `label` is SQL text."""
    state = f"{rec}.availability"
    compared = (
        f"concat(' vs ', {value_text(f'{rec}.previous', unit, currency, style)}, ' (', "
        f"{delta_text(f'{rec}.absolute_change', unit, currency, style)}, ', ', "
        f"{percent_text(f'{rec}.percent_change', f'{rec}.verdict', style)}, ')')"
    )
    return (
        f"concat({label}, ': ', {value_text(f'{rec}.current', unit, currency, style)}, "
        f"CASE {state} WHEN 'unavailable' THEN '' "
        f"WHEN 'partial' THEN ' this period, no comparable figure last period' "
        f"ELSE {compared} END)"
    )


def csv_cell(value: str) -> str:
    """Null is an empty cell, a whole number has no decimals, anything else has four."""
    v = f"CAST({value} AS DOUBLE)"
    return (
        f"CASE WHEN {value} IS NULL THEN '' WHEN abs({v} - rint({v})) < 1e-9 "
        f"THEN CAST(CAST(rint({v}) AS BIGINT) AS STRING) ELSE {plain(value, 4)} END"
    )
