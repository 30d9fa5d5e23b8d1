"""Secrets in texts, with the parts of a credential linked by their distance.

Some strings are secrets by their form alone: assignments to a password or token, access key ids,
long hexadecimal strings. Others are only candidates: a user name, a bare key of mixed characters, an
endpoint. A candidate is reported when its complement is in its scope, that is within REACH code
points of it: a bare key near an identifier, a name near a secret, an endpoint near a secret that has
an identifier near.

Everything is column expressions. A pattern is cut from a text as segments, each the stretch up to a
match and the match; their running length is the position. Scopes and parts are joined as intervals
in one sweep over the positions of a text: of the parts that start before a scope ends, the one that
stops last tells whether the scope holds any. No pair of parts is ever formed, so a text with very
many parts costs one row for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

REACH = 200


@dataclass(frozen=True)
class Kind:
    """A pattern, what it is a part of, and whether it counts alone. `value` is the group whose length
    has to be `least` (0: the whole match); `also` are patterns that the match has to hold too."""

    name: str
    role: str
    pattern: str
    value: int = 0
    least: int = 1
    alone: bool = False
    also: tuple[str, ...] = ()


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", "secret", ASSIGN, value=2, least=6, alone=True),
    Kind("access", "identifier", "AKIA[A-Z0-9]{16,}", alone=True),
    Kind("hex", "secret", "[0-9a-f]{24,}", alone=True),
    Kind("user", "identifier", r"""(?i:(user|username|login|client_?id|account|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", value=2, least=3),
    Kind("key", "secret", "[A-Za-z0-9+/]{32,}={0,2}", also=("[a-z]", "[A-Z]", "[0-9]")),
    Kind("endpoint", "endpoint", r"""(?i:(https?|wss?|ftps?|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqps?|s3))://[^\x00-\x20"'<>]+"""),
)


def _segments(text: Column, kind: Kind) -> Column:
    """For every match, in order: how far it ends from the end of the one before, and its size, which is
    0 if it does not count. Matches are leftmost and do not overlap."""
    # \G ties a segment to the end of the last one, so what follows the last match is read only once.
    found = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{kind.pattern})"), F.lit(0))

    def part(s: Column) -> Column:
        match = F.regexp_extract(s, kind.pattern, 0)
        counts = F.char_length(F.regexp_extract(s, kind.pattern, kind.value)) >= kind.least
        for pattern in kind.also:
            counts = counts & match.rlike(pattern)
        return F.struct(F.char_length(s).alias("advance"), F.when(counts, F.char_length(match)).otherwise(0).alias("size"))

    return F.transform(found, part)


def matches(
    docs: DataFrame, carry: list[str], scratch: Scratch, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` (rid and row, a struct of `carry`) and every match that counts: rid, kind (its
    number in `kinds`), start, stop in code points (stop exclusive)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = scratch.write(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.struct(*carry).alias("row"),
        F.array(*(_segments(text, kind) for kind in kinds)).alias("found")), "found")
    of_kind = found.where("exists(found, x -> size(x) > 0)").select("rid", F.posexplode("found").alias("kind", "segments"))
    one = of_kind.select("rid", "kind", F.posexplode("segments").alias("nth", "s")).select("rid", "kind", "nth", "s.*")
    upto = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("stop", F.sum("advance").over(upto)).where("size > 0")
    return found.select("rid", "row"), scratch.write(placed.select("rid", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop"), "spans")


def linked(spans: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """The rows of `spans` with one of `others` (both rid, kind, start, stop) in reach, and as `partner`
    that of them which stops last (then starts last): at most `reach` code points lie between them.
    A reach of -1 asks for a common code point."""
    scopes = spans.select("rid", (F.col("stop") + reach).alias("at"), F.lit(1).alias("side"), F.struct("kind", "start", "stop").alias("span"))
    found = others.select("rid", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("stop", "start", "kind").alias("partner"))
    order = Window.partitionBy("rid").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = scopes.unionByName(found, allowMissingColumns=True).withColumn("partner", F.max("partner").over(order))
    return both.where(F.col("partner.stop") >= F.col("span.start") - reach).where("side = 1").select("rid", "span.*", "partner")


def credentials(spans: DataFrame, scratch: Scratch, kinds: tuple[Kind, ...] = KINDS, reach: int = REACH) -> DataFrame:
    """The spans to report (rid, kind, start, stop) with `partner`, the part they are linked to, if any.

    Spans of kinds that count alone are all reported. A candidate that overlaps one of them, or a bare
    key inside an endpoint, is part of it and dropped. A candidate secret needs an identifier in reach,
    a candidate identifier a secret, an endpoint a secret with an identifier in reach of that.
    """
    def of(*tests) -> DataFrame:
        return spans.where(F.col("kind").isin([k for k, kind in enumerate(kinds) if all(test(kind) for test in tests)]))

    def role(name: str):
        return lambda kind: kind.role == name

    def alone(kind: Kind) -> bool:
        return kind.alone

    # Only texts with a candidate and its complement go on; most texts with secrets have none.
    weak = of(lambda kind: not kind.alone)
    texts = scratch.write(weak.select("rid").distinct(), "candidates")
    spans_of = [of(role(r)).join(texts, "rid", "left_semi") for r in ("secret", "identifier", "endpoint")]
    covers = of(alone).join(texts, "rid", "left_semi")
    key = ["rid", "kind", "start", "stop"]
    taken = linked(of(role("identifier"), lambda kind: not kind.alone), covers, -1).unionByName(
        linked(of(role("secret"), lambda kind: not kind.alone), covers.unionByName(spans_of[2]), -1)).select(*key)
    taken = scratch.write(taken, "covered")
    secret, identifier = (x.join(taken, key, "left_anti") for x in spans_of[:2])
    with_id = scratch.write(linked(secret, identifier, reach), "secrets")
    found = with_id.unionByName(linked(identifier, secret, reach)).unionByName(linked(spans_of[2], with_id.select(*key), reach))
    found = scratch.write(found, "linked")
    return of(alone).join(found, key, "left").unionByName(found.join(of(alone), key, "left_anti"))


def _text(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """kind:start:stop of sorted spans, comma-joined."""
    names = F.array(*(F.lit(kind.name) for kind in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(
    docs: DataFrame, scratch: Scratch, carry: list[str], text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, reach: int = REACH,
) -> DataFrame:
    """row (a struct of `carry`), n_<kind> for every kind that counts alone, base_sha256 (the digest of
    those spans), spans (all that is reported) and links (of every reported part that has one, its own
    place and that of its partner).

    Spans are kind:start:stop in code points, by start and then by kind. A null or empty text has
    none: zeros, the digest of the empty string, empty strings. Repeated rows are scanned each and all
    returned; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows, spans = matches(docs, carry, scratch, text_col, kinds)
    base = [k for k, kind in enumerate(kinds) if kind.alone]
    place = F.struct("start", "kind", "stop")
    # The spans of one text; they are no larger than the text.
    told = credentials(spans, scratch, kinds, reach).groupBy("rid").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{kinds[k].name}") for k in base),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(base), place))).alias("base"),
        F.sort_array(F.collect_list(place)).alias("spans"),
        F.sort_array(F.collect_list(F.when(F.col("partner").isNotNull(), F.struct("start", "kind", "stop", "partner")))).alias("links"))
    own, other = (lambda f: F.transform(F.col("links"), f)), F.array_join
    pairs = F.arrays_zip(own(lambda x: x.dropFields("partner")).alias("a"), own(lambda x: x["partner"]).alias("b"))
    return rows.join(told, "rid", "left").select(
        "row", *(F.coalesce(f"n_{kinds[k].name}", F.lit(0).cast("long")).alias(f"n_{kinds[k].name}") for k in base),
        F.sha2(F.coalesce(_text(F.col("base"), kinds), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_text(F.col("spans"), kinds), F.lit("")).alias("spans"),
        F.coalesce(other(F.transform(pairs, lambda p: F.concat(
            _text(F.array(p["a"]), kinds), F.lit(">"), _text(F.array(p["b"]), kinds))), ","), F.lit("")).alias("links"))
