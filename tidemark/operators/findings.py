"""Findings and recommendations as rows.

A rule is SQL text for a condition and the finding it yields. All rules over one frame are
evaluated in a single pass: the row's findings form an array, nulls drop out, the rest is
unnested. One scan therefore serves every rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import Kpi
from ..functions.display import ADS_STYLE, Style, evidence_line, quoted
from .aggregate import ranked_all

# Words of finding ids that are written in capitals.
CAPITALS = ("cpa", "cpc", "ctr", "roas", "url")


def rule(
    when: str,
    id: str,
    type: str,
    severity: str = "'medium'",
    confidence: str = "'high'",
    scope: str = "'account'",
    entity: str = "NULL",
    amount: str = "NULL",
    detail: str = "NULL",
    evidence: list[str] | None = None,
) -> str:
    lines = f"array_compact(array({', '.join(evidence)}))" if evidence else "array()"
    text = {"id": id, "type": type, "severity": severity, "confidence": confidence,
            "scope": scope, "entity": entity}
    fields = [f"'{name}', CAST({sql} AS STRING)" for name, sql in text.items()]
    fields += [
        f"'amount', CAST({amount} AS DOUBLE)", f"'detail', CAST({detail} AS STRING)",
        f"'evidence', CAST({lines} AS ARRAY<STRING>)",
    ]
    return f"CASE WHEN {when} THEN named_struct({', '.join(fields)}) END"


def fire(df: DataFrame, rules: list[str], keys: tuple[str, ...] = ("property_id",)) -> DataFrame:
    return df.selectExpr(*keys, f"inline(array_compact(array({', '.join(rules)})))")


def with_lines(
    kpis: DataFrame, specs: list[Kpi], currency: str = "''", style: Style = ADS_STYLE
) -> DataFrame:
    """One evidence line `e_<key>` per KPI, so that rules share it as a column."""
    return kpis.withColumns({
        f"e_{s.key}": F.expr(evidence_line(f"k_{s.key}", quoted(s.label), s.unit, currency, style))
        for s in specs
    })


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def with_sentences(findings: DataFrame) -> DataFrame:
    """Add `sentence`: what was found, where, and the figures behind it, in one line to read.

    The name of the finding becomes words and its evidence the figures; a finding of the whole account
    names no entity.
    """
    capitals = ", ".join(f"'{w}'" for w in CAPITALS)
    words = f"transform(split(substring_index(id, ':', 1), '_'), w -> if(w IN ({capitals}), upper(w), w))"
    return findings.withColumn("_said", F.expr(f"array_join({words}, ' ')")).withColumn("sentence", F.expr(
        "concat(upper(substr(_said, 1, 1)), substr(_said, 2), if(scope <> 'account' AND coalesce(entity, '') <> '', concat(', ', entity), ''), "
        "if(size(evidence) > 0, concat(': ', array_join(evidence, '; ')), ''), '.')")).drop("_said")


# prefix, required type, required severity, required confidence, priority (None: by severity),
# confidence (None: the finding's own), action
Rule = tuple[str, str | None, str | None, str | None, str | None, str | None, str]

def _text(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def recommend(findings: DataFrame, rules: list[Rule], dedupe: bool = False) -> DataFrame:
    """Recommendations for findings that a rule covers. No finding, no recommendation.

    The rules become SQL text, as those of findings do: one pass over the findings, no join.
    """
    cases = []
    for prefix, kind, severity, confidence, priority, own_confidence, template in rules:
        needs = [("prefix", prefix), ("type", kind), ("severity", severity), ("confidence", confidence)]
        when = " AND ".join(f"{column} = {_text(value)}" for column, value in needs if value is not None)
        cases.append(
            f"CASE WHEN {when} THEN named_struct('action', replace({_text(template)}, '{{entity}}', coalesce(entity, '')), "
            f"'priority', coalesce({_text(priority)}, initcap(severity)), "
            f"'own', coalesce({_text(own_confidence)}, confidence)) END")
    # Rules that share a finding each give their own recommendation.
    out = findings.withColumn("prefix", F.substring_index("id", ":", 1)).select(
        "*", F.explode(F.expr(f"array_compact(array({', '.join(cases)}))")).alias("r"),
    ).selectExpr(
        "property_id", "id AS from_finding", "r.action AS action", "r.priority AS priority", "r.own AS confidence",
        "entity", "amount", "detail", "evidence",
    ).withColumn("priority_rank", priority_rank(F.col("priority")))
    return first_per_action(out) if dedupe else out


def priority_rank(priority: Column) -> Column:
    chain = F.when(priority == "High", 0).when(priority == "Medium", 1).when(priority == "Low", 2)
    return chain.otherwise(3)


def first_per_action(recommendations: DataFrame) -> DataFrame:
    """One row per property and action, the highest priority kept.

    A minimum over a struct combines before the shuffle, unlike a ranking window.
    """
    rest = [c for c in recommendations.columns if c not in ("property_id", "action")]
    first = ["priority_rank", "from_finding"]
    fields = first + [c for c in rest if c not in first]
    best = recommendations.groupBy("property_id", "action").agg(
        F.min(F.struct(*fields)).alias("best"))
    return best.select("property_id", "action", "best.*")


def ordered(recommendations: DataFrame) -> DataFrame:
    """Number recommendations inside each property: priority first, then finding id."""
    return ranked_all(
        recommendations, ["property_id"], ["priority_rank", "from_finding", "action"], "position")
