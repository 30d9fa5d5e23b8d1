"""Quality rules from tokeniser fertility.

A public vocabulary splits every word. Characters per token, tokens per word, the share of byte
fallback tokens, the entropy of the tokens and the share of the most frequent one (min-entropy) tell
prose from symbol noise, shouting, hashes and loops. Normal values differ between languages and,
entropy above all, with the length of a text. So the rejection bands come from the corpus itself:
median and quartiles per language and size (half powers of two of the number of tokens), over all
documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# White space to str.split() that does not end a word here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 250_000  # words a worker remembers at a time; bounds its memory only
SCRIPTS = (  # first code point, name: the script of letters from there on
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
)


@dataclass(frozen=True)
class Rules:
    """The limits of the verdict; widths are in deviations (quartile distance / 0.6745) from the median."""

    min_words: int = 50
    max_repeat_percent: int = 50
    width: float = 4.5  # on the side of noise
    other_width: float = 10.0  # too many characters per token
    top_width: float = 6.75  # share of the most frequent token, whose distribution is skewed
    min_docs: int = 50  # a language and size with fewer documents uses a wider band


# The least deviation that counts as one, so that a very even corpus has no narrow band.
SCALES = {"chars_per_token": 0.03, "tokens_per_word": 0.05, "byte_share": 0.01, "entropy": 0.01, "top_share": 0.005}


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


class Fertility:
    """Token ids of words by a public sentencepiece vocabulary, remembered per word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u2")
        except KeyError:
            pass
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for start in range(0, len(words), CACHE_WORDS):
            part = words[start:start + CACHE_WORDS]
            new = [w for w in dict.fromkeys(part) if w not in known]
            local = {w: np.array(t, "<u2").tobytes() for w, t in zip(new, self.model.encode(new, num_threads=1), strict=True)}
            out.append(b"".join([known[w] if w in known else local[w] for w in part]))
            if len(known) + len(local) <= 2 * CACHE_WORDS:
                known.update(local)
        return np.frombuffer(b"".join(out), "<u2")


_loaded: dict[str, Fertility] = {}


def fertility(path: str) -> Fertility:
    if path not in _loaded:
        _loaded[path] = Fertility(path)
    return _loaded[path]


def script_of(text: str) -> str:
    """The script most of the letters belong to; 'none' without letters."""
    letters = [ord(c) for c in text if c.isalpha()]
    if not letters:
        return "none"
    at = np.searchsorted([s for s, _ in SCRIPTS], letters, side="right") - 1
    counts: dict[str, int] = {}
    for i, n in enumerate(np.bincount(at, minlength=len(SCRIPTS))):
        counts[SCRIPTS[i][1]] = counts.get(SCRIPTS[i][1], 0) + int(n)
    return max(counts, key=lambda k: (counts[k], k))


def repeat_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    grams = textnum.shingles(hashes, width)
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(width):
        covered[k:n + k] |= twice
    return int(covered.sum())


def token_spread(ids: np.ndarray) -> tuple[float, float]:
    """Token entropy as a share of the largest that so many tokens can have, and the share of the
    most frequent token; 1 and 1 for up to one token."""
    if len(ids) < 2:
        return 1.0, 1.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(len(ids))), float(p.max())


METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, tokens_per_word double, byte_share double, entropy double, top_share double, "
    "band string, size int"
)


def _measurer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fertility(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                data, offsets = textnum.buffer(batch.column("text"))
                hashes, _, _, counts = textnum.word_hashes(data, offsets)
                ends = np.cumsum(counts)
                rows = []
                texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
                    text = text or ""
                    words = words_of(text)
                    ids = model.ids(words)
                    chars = sum(map(len, words))
                    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                    spread = [round(x, 3) for x in token_spread(ids)]
                    rows.append((
                        len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                        repeat_words(hashes[ends[k] - counts[k]:ends[k]]), len(ids),
                        round(chars / len(ids), 3) if len(ids) else 0.0,
                        round(len(ids) / len(words), 3) if words else 0.0,
                        round(float(model.is_byte[ids].mean()), 3) if len(ids) else 0.0,
                        *spread, lang if lang else "script " + script_of(text),
                        int(2 * np.log2(len(ids))) if len(ids) else -1))
                kinds = [pa.int64()] * 6 + [pa.float64()] * 5 + [pa.string(), pa.int32()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                    ["row", *(m.split()[0] for m in METRICS.split(", "))])
    return run


def measure(
    docs: DataFrame, carry: list[str], vocabulary: str, text_col: str = "text", lang_col: str | None = "lang",
) -> DataFrame:
    """`row`, a struct of the columns in `carry`, and the measures of every document.

    A null text has no words. Documents without a language are grouped by their main script.
    Columns that are not carried are ignored, whatever their names; rows and their number stay.
    """
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"), lang.alias("lang"))
    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(_measurer(vocabulary), f"row {row}, {METRICS}")


def bands(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rejection band of every language and size, one row for each that occurs.

    Median and quartiles come from one aggregation; the deviation is that of the half away from the
    noise, so that noise in the corpus does not widen the band. Documents that fail the base rules do
    not count. With fewer than `min_docs` documents of a language and size, the band of the language
    holds, then that of the size, then that of all documents. Measures are rounded to a thousandth,
    so an exact percentile holds a few thousand values.
    """
    # A key that is the same for all rows, and not a constant, which would make the join a cross join.
    every = (F.col("size") < -9).cast("int")
    plain = measured.where(~base_failed(rules)).select("band", "size", every.alias("every"), *SCALES)

    def limit(name, at, width, side):
        low, mid, high = (F.col(f"{name}_q")[k] for k in range(3))
        spread = F.greatest(((high - mid) if at < 0 else (mid - low)) / 0.6745, F.lit(SCALES[name]))
        return (mid + at * width * spread).alias(side)

    limits = F.struct(
        limit("chars_per_token", -1, rules.width, "cpt_low"),
        limit("chars_per_token", 1, rules.other_width, "cpt_high"),
        limit("tokens_per_word", 1, rules.width, "tpw_high"),
        limit("byte_share", 1, rules.width, "byte_high"),
        limit("entropy", -1, rules.width, "entropy_low"),
        limit("top_share", 1, rules.top_width, "top_high"),
    )

    def level(keys, name):
        quartiles = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), *(
            F.percentile(n, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"{n}_q") for n in SCALES))
        return quartiles.where((F.col("docs") >= rules.min_docs) | F.lit(name == "l4")).select(*keys, limits.alias(name))

    out = measured.groupBy("band", "size").agg(F.count(F.lit(1)).alias("docs")).withColumn("every", every)
    for keys, name in ((["band", "size"], "l1"), (["band"], "l2"), (["size"], "l3"), (["every"], "l4")):
        out = out.join(level(keys, name), keys, "left")
    return out.select("band", "size", F.coalesce("l1", "l2", "l3", "l4").alias("limits"))


def base_failed(rules: Rules = Rules()):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def judge(measured: DataFrame, limits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add base_failed, kept and reason to measured documents.

    The table of bands has one row per language and size. Catalyst broadcasts it if its measured
    size allows; else adaptive execution splits the frequent ones, as both sides are written tables.
    """
    joined = measured.join(limits, ["band", "size"], "left")

    def limit(name):
        return F.col("limits." + name)

    reason = (
        F.when(F.col("n_words") < rules.min_words, "few words")
        .when(base_failed(rules), "repeats")
        .when(F.col("chars_per_token") < limit("cpt_low"), "short tokens")
        .when(F.col("chars_per_token") > limit("cpt_high"), "long tokens")
        .when(F.col("tokens_per_word") > limit("tpw_high"), "many tokens a word")
        .when(F.col("byte_share") > limit("byte_high"), "byte fallback")
        .when(F.col("entropy") < limit("entropy_low"), "low entropy")
        .when(F.col("top_share") > limit("top_high"), "one token")
    )
    return joined.withColumns({"base_failed": base_failed(rules), "reason": reason}).select(
        *measured.columns, "base_failed", F.col("reason").isNull().alias("kept"), "reason")


def quality(
    docs: DataFrame, scratch: Scratch, carry: list[str], vocabulary: str, text_col: str = "text",
    lang_col: str | None = "lang", rules: Rules = Rules(),
) -> DataFrame:
    """Measure every document, take the bands from all of them and judge each.

    An empty table gives no rows. Repeated rows are judged alike and all returned.
    """
    measured = scratch.write(measure(docs, carry, vocabulary, text_col, lang_col), "measured")
    limits = scratch.write(bands(measured, rules), "bands")
    return judge(measured, limits, rules)
