"""Clean a corpus in stages, each of which applies one operator and writes its result.

    quality rules -> near-duplicates -> repeated passages -> benchmark decontamination -> packing

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the
next stage reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, packing, quality_rules, repeats
from tidemark.llm.common import Scratch, with_row_ids
from tidemark.session import configure

_open = threading.local()
_single: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's own tables. `run` removes those of its own stages. Whoever calls the stages one by one
    writes each result before the next call, so that call removes the tables of the one before."""
    scratch = Scratch(spark, name, "zstd")
    if (stages := getattr(_open, "stages", None)) is not None:
        stages.append(scratch)
        return scratch
    while _single:
        if (old := _single.pop()).spark is spark:
            old.clear()
    _single.append(scratch)
    return scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    out = quality_rules.quality(
        docs, _scratch(spark, "quality"), docs.columns, public_tokenizers.path("piece_bpe_32k.model"))
    return out.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (a similarity of 0.8 or more), that with the
    smallest doc_id. With 28 bands of 5 a pair at exactly 0.8 shares no band once in 67,000 pairs."""
    scratch = _scratch(spark, "near")
    rows = with_row_ids(docs, scratch, F.struct(*docs.columns).alias("row"), name="docs")
    out = near_dedup.near_duplicates(rows, scratch, id_col="row.doc_id", text_col="row.text", num=80, band_rows=5, tie="rid")
    first = out.where("first").select(F.col("tie").alias("rid"))
    return rows.join(first.hint("shuffle_hash"), "rid", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of over 50 words, or of 400 bytes and more, that occur more
    than once; what is left of its text."""
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = repeats.remove_repeats(docs, _scratch(spark, "repeats"), [*carry, "n_chars"], with_text=True, words=51)
    text = F.col("kept_text")
    return out.select(*(
        text.alias(c) if c == "text" else F.when(F.col("n_spans") + F.col("n_passages") > 0, F.length(text)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col("row")[c].alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, _scratch(spark, "leaks"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    out = packing.pack(docs, _scratch(spark, "packing"), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))
    return out.select("row.doc_id", *out.columns[1:])


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again. The result is
    lazy: the tables of its last stage and the documents it reads stay, those of earlier stages go."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    results, outer = Scratch(spark, "pipeline", "zstd"), getattr(_open, "stages", None)
    for k, (_, stage) in enumerate(STAGES):
        _open.stages = []
        try:
            out = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return out
            docs = results.write(out, f"stage-{k}")
            for scratch in _open.stages:
                scratch.clear()
        finally:
            _open.stages = outer
        if k:
            results.drop(f"stage-{k - 1}")
    return docs


#: Tokenisers and sketches have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
