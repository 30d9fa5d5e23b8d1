"""Expense ledger: checks, duplicates, archive names, review reasons, audit and run summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.catalog import (
    CLEARABLE_REASONS, LEGAL_SUFFIXES, NET_TOLERANCE, REVIEW_CONFIDENCE, RUN_ARTEFACTS,
)
from ..functions.dates import iso_date
from ..functions.display import ledger_amount
from ..functions.text import (
    archive_folder, archive_stem, currency_code, extension, merchant_key, money,
)
from ..session import stage
from .aggregate import counted_before, join_unique, least_before, numbered
from .components import components


def check_rows(raw: DataFrame) -> DataFrame:
    """Typed receipts from text columns, with the reason when a row is refused.

    Net is gross minus tax; a given net must agree within a cent, tax may not exceed a
    non-negative gross, confidence lies in 0..1 and a flagged row needs a note. An empty tax is
    zero and an empty net follows from the others; one that cannot be read refuses the row.
    """
    typed = raw.withColumns({
        "purchase_date": iso_date(F.col("purchase_date")),
        "gross": money(F.col("gross_amount")),
        "tax": F.when(_blank("tax_amount"), F.lit(0).cast("decimal(18,2)")).otherwise(money(F.col("tax_amount"))),
        "bad_net": ~_blank("net_amount") & money(F.col("net_amount")).isNull(),
        "given_net": money(F.col("net_amount")),
        "conf": F.expr("CAST(bround(try_cast(confidence AS DECIMAL(10,6)), 2) AS DECIMAL(10,2))"),
        "currency": currency_code(F.col("currency")),
    }).withColumns({
        "net": F.coalesce("given_net", F.expr("CAST(gross - tax AS DECIMAL(18,2))")),
        "flagged": F.expr(f"coalesce(needs_review, false) OR conf < {REVIEW_CONFIDENCE}"),
    })
    reason = F.expr(
        "CASE WHEN purchase_date IS NULL THEN 'date is not ISO' "
        "WHEN gross IS NULL THEN 'gross is not a number' "
        "WHEN tax IS NULL THEN 'tax is not a number' "
        "WHEN bad_net THEN 'net is not a number' "
        f"WHEN given_net IS NOT NULL AND abs((gross - tax) - given_net) > {NET_TOLERANCE} "
        "THEN 'arithmetic does not reconcile' "
        "WHEN gross >= 0 AND tax > gross THEN 'tax exceeds gross' "
        "WHEN conf IS NULL THEN 'confidence is not a number' "
        "WHEN conf < 0 OR conf > 1 THEN 'confidence outside 0..1' "
        "WHEN flagged AND trim(coalesce(review_notes, '')) = '' THEN 'flag without a note' END")
    return typed.withColumn("reject_reason", reason).drop(
        "gross_amount", "tax_amount", "net_amount", "given_net", "bad_net", "confidence", "needs_review"
    ).withColumnsRenamed({
        "gross": "gross_amount", "tax": "tax_amount", "net": "net_amount", "conf": "confidence",
        "flagged": "needs_review",
    })


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def tax_from_rate(gross_or_net, rate, inclusive):
    """Tax contained in a printed total, from a printed rate; columns of decimals."""
    inside = gross_or_net * rate / (F.lit(100) + rate)
    added = gross_or_net * (F.lit(100) + rate) / F.lit(100) - gross_or_net
    return F.round(F.when(inclusive, inside).otherwise(added), 2).cast("decimal(18,2)")


def with_match_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "merchant_key": merchant_key(F.col("merchant")),
        "number_key": F.expr("nullif(lower(trim(coalesce(receipt_number, ''))), '')"),
    })


NUMBER_KEY = ["client", "merchant_key", "number_key"]
AMOUNT_KEY = ["client", "merchant_key", "purchase_date", "gross_amount"]


# Rounds in which independent rows of a batch settle at once; what is left is filed in order.
PARALLEL_ROUNDS = 6
# Rows of one group of look-alikes that a task files in order at a time.
FILING_BLOCK = 100_000
# Files and taken numbers of one name that a task numbers at once, and the buckets of names they are counted in.
NAMING_BLOCK = 1_000_000
NAMING_BUCKETS = 65_536


def _position(rank: int, at: str) -> Column:
    """Ledger lines (rank 0) come before batch rows (rank 1), whatever their numbers."""
    return F.struct(F.lit(rank).alias("rank"), F.col(at).cast("bigint").alias("at")).alias("pos")


def _firsts(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first position per receipt number, and per date and gross amount."""
    by_number = written.filter("number_key IS NOT NULL").groupBy(*NUMBER_KEY).agg(F.min("pos").alias("number_pos"))
    return by_number, written.groupBy(*AMOUNT_KEY).agg(F.min("pos").alias("amount_pos"))


def _first_hits(rows: DataFrame, by_number: DataFrame, by_amount: DataFrame) -> DataFrame:
    """Earliest written row with the same number, or the same date and gross.

    Written rows shrink to one per key before they are joined, so neither a repeated ledger entry
    nor a repeated batch row multiplies. Two equality joins replace the OR of the two rules. Rows
    without a number match none and stay out of the number join, where they would fill one task.
    """
    numbered_rows = join_unique(rows.filter("number_key IS NOT NULL"), by_number, NUMBER_KEY)
    found = by_number.schema[-1]
    bare = rows.filter("number_key IS NULL").withColumn(found.name, F.lit(None).cast(found.dataType))
    return join_unique(numbered_rows.unionByName(bare), by_amount, AMOUNT_KEY)


def _described(hit: DataFrame) -> DataFrame:
    first = F.least("number_pos", "amount_pos")
    return hit.withColumns({
        "duplicate_of": first["at"],
        "duplicate_in_batch": first["rank"] == 1,
        "duplicate_reason": F.expr(
            "CASE WHEN number_pos <= coalesce(amount_pos, number_pos) THEN 'same receipt number' "
            "WHEN amount_pos IS NOT NULL THEN 'same date and gross amount' END"),
    }).drop("number_pos", "amount_pos")


def find_duplicates(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batch rows with the first ledger line that looks like them.

    Both need client, merchant, receipt_number, purchase_date and gross_amount; the ledger has
    `line`. On the same line a number match counts before a match of date and amount. Of the ledger
    only the keys of the batch are written and joined.
    """
    rows = with_match_keys(batch)
    booked = with_match_keys(ledger).withColumn("pos", _position(0, "line"))
    return _described(_first_hits(rows, *_firsts_for(rows, booked))).drop("duplicate_in_batch")


def _firsts_for(rows: DataFrame, booked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first positions of the keys that `rows` have. An empty ledger has none: the keys are not shuffled for it."""
    if booked.isEmpty():
        return _firsts(booked)
    numbers = rows.filter("number_key IS NOT NULL").select(*NUMBER_KEY).distinct()
    return (_firsts(booked.join(numbers, NUMBER_KEY, "left_semi"))[0],
            _firsts(booked.join(rows.select(*AMOUNT_KEY).distinct(), AMOUNT_KEY, "left_semi"))[1])


def _file_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """File rows one after the other; they come by component, in the order of the batch."""
    component, numbers, amounts = None, set(), set()
    for rows in batches:
        states = []
        for group, client, merchant, number, day, gross, force, dup in zip(*(rows.column(c).to_pylist() for c in (
                "component", "client", "merchant_key", "number_key", "purchase_date", "gross_amount", "force", "dup")), strict=True):
            if group != component:
                component, numbers, amounts = group, set(), set()
            # As in a join, a missing part of a key matches nothing.
            by_number = (client, merchant, number) if None not in (client, merchant, number) else None
            by_amount = (client, merchant, day, gross) if None not in (client, merchant, day, gross) else None
            if not force and (dup or by_number in numbers or by_amount in amounts):
                states.append("duplicate")
                continue
            states.append("written")
            numbers |= {by_number} - {None}
            amounts |= {by_amount} - {None}
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(states, pa.string())], names=[*rows.schema.names, "state"])


def _filed(rows: DataFrame) -> DataFrame:
    """Rows of whole components with their state, filed in order."""
    schema = StructType([*rows.schema.fields, StructField("state", StringType())])
    return stage(rows.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(_file_in_order, schema), "batch-filed")


def _shared_firsts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of each number, and of each date and gross amount, that more than one row has."""
    def first(of: DataFrame, key: list[str], out: str) -> DataFrame:
        return of.groupBy(*key).agg(F.min("seq").alias(out), F.count("*").alias("n")).filter("n > 1").drop("n")

    return first(rows.filter("number_key IS NOT NULL"), NUMBER_KEY, "number_first"), first(rows, AMOUNT_KEY, "amount_first")


def _hits_in_batch(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Rows with the first of `written` that has their number, or their date and gross. A key that no other row
    of the batch has is left out."""
    return _first_hits(rows, written.filter("number_shared").groupBy(*NUMBER_KEY).agg(F.min("seq").alias("number_new")),
                       written.filter("amount_shared").groupBy(*AMOUNT_KEY).agg(F.min("seq").alias("amount_new")))


def _marked(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Open rows, as duplicates where an earlier one of `written` looks like them."""
    return stage(_hits_in_batch(rows, written).withColumn("dup", F.expr(
        "dup OR coalesce(number_new < seq, false) OR coalesce(amount_new < seq, false)")).drop("number_new", "amount_new"), "batch-open")


def _file_components(waiting: DataFrame, block: int) -> list[DataFrame]:
    """Settle open rows in order: frames of them with their state.

    Rows that share a number, or a date and amount, with open rows make a component; components do
    not depend on each other and are filed side by side. One with more rows than a block goes in
    blocks of its order: what a block has written marks the rows after it before the next one. A task
    holds the keys of one block. If all that is open fits in one, merchants stand for components.
    """
    if waiting.count() <= block:
        return [_filed(waiting.withColumn("component", F.xxhash64("client", "merchant_key")))]
    near = _first_hits(waiting, *_shared_firsts(waiting))
    links = near.select(F.explode(F.array("number_first", "amount_first")).alias("a"), F.col("seq").alias("b")).filter("a IS NOT NULL")
    joined = waiting.withColumn("node", F.col("seq")).join(components(links), "node", "left").withColumn(
        "component", F.coalesce("component", "node")).drop("node")
    joined = stage(numbered(joined, ["component"], "seq", "nth").withColumn("block", F.expr(f"(nth - 1) div {block}")).drop("nth"), "batch-components")
    last, settled = joined.agg(F.max("block")).first()[0], []
    for b in range((last or 0) + 1):
        filed = _filed(joined.filter(F.col("block") == b))
        settled.append(filed)
        if b < (last or 0):
            joined = _marked(joined.filter(F.col("block") > b), filed.filter("state = 'written'"))
    return settled


def file_batch(
    batch: DataFrame, ledger: DataFrame | Callable[[DataFrame], DataFrame], rounds: int = PARALLEL_ROUNDS, block: int = FILING_BLOCK
) -> DataFrame:
    """Decide every row of a batch as if rows were filed one at a time in the order of `seq`.

    A row is a duplicate when an earlier row that was itself written looks like it; a stopped row
    is not in the ledger and stops nobody. `force` files a duplicate all the same, with a note.

    The ledger shrinks once to the keys of the batch. A round then settles all rows whose earlier
    look-alikes are settled and carries on with the others only. Chains of look-alikes that are
    longer than the rounds are filed in order, each connected group of them by itself and a large one
    in blocks. Joins meet only keys that several rows have, and only rows that need a reason look for
    the row they repeat. `seq` is unique in the batch. The batch is written once; `ledger` may be a
    function that gets the written rows and returns the lines that can match them.
    """
    keys = ["client", "merchant_key", "number_key", "purchase_date", "gross_amount"]
    rows = stage(with_match_keys(batch), "batch")
    booked = with_match_keys(ledger(rows) if callable(ledger) else ledger).withColumn("pos", _position(0, "line")).select(*keys, "pos")
    waiting = rows.select(F.col("seq").cast("bigint").alias("seq"), *keys, F.coalesce("force", F.lit(False)).alias("force"))
    waiting = _first_hits(waiting, *_firsts_for(rows, booked)).select(
        "seq", *keys, "force", F.col("number_pos.at").alias("number_old"), F.col("amount_pos.at").alias("amount_old"),
        F.expr("number_pos IS NOT NULL OR amount_pos IS NOT NULL").alias("dup"),
        F.lit(True).alias("number_shared"), F.lit(True).alias("amount_shared"))
    waiting, settled = stage(waiting, "batch-open"), []
    for nth in range(rounds):
        judged = _first_hits(waiting, *_shared_firsts(waiting)).withColumn("state", F.expr(
            "CASE WHEN dup AND NOT force THEN 'duplicate' WHEN force THEN 'written' "
            "WHEN coalesce(number_first, seq) = seq AND coalesce(amount_first, seq) = seq THEN 'written' "
            "ELSE 'open' END"))
        if not nth:
            # Of the whole batch: a row may repeat one that is settled in a later round. Until then any key may be shared.
            judged = judged.withColumns({"number_shared": F.col("number_first").isNotNull(), "amount_shared": F.col("amount_first").isNotNull()})
        judged = stage(judged.drop("number_first", "amount_first"), "batch-judged")
        settled.append(judged.filter("state <> 'open'"))
        waiting = _marked(judged.filter("state = 'open'").drop("state"), judged.filter("state = 'written'"))
        if waiting.isEmpty():
            break
    else:
        settled += _file_components(waiting, block)
    settled = reduce(DataFrame.unionByName, (s.drop("component", "block") for s in settled))
    # What is written without force repeats nothing before it.
    repeats = _hits_in_batch(settled.filter("state = 'duplicate' OR force"), settled.filter("state = 'written'"))
    place = ("CASE WHEN {0}_old IS NOT NULL THEN named_struct('rank', 0, 'at', {0}_old) "
             "WHEN {0}_new < seq THEN named_struct('rank', 1, 'at', {0}_new) END AS {0}_pos")
    first = settled.filter("state = 'written' AND NOT force").selectExpr("seq", "state")
    verdicts = stage(repeats.selectExpr("seq", "state", place.format("number"), place.format("amount")).unionByName(
        first, allowMissingColumns=True), "batch-states")
    hit = rows.withColumn("seq", F.col("seq").cast("bigint")).join(verdicts, "seq")
    note = F.when(F.coalesce("number_pos", "amount_pos").isNotNull() & (F.col("state") == "written"), F.trim(F.concat(
        F.coalesce("review_notes", F.lit("")), F.lit(" [forced past a suspected duplicate]"))))
    return _described(hit.withColumn("review_notes", F.coalesce(note, F.col("review_notes"))))


def archive_names(rows: DataFrame, archived: DataFrame | None = None, block: int = NAMING_BLOCK) -> DataFrame:
    """Folder and collision-free name per row: the first name that is free, `stem`, `stem-2`, ...

    A file already in its folder under its stem keeps its name. `archived` has client, folder, stem,
    ext and `n`, the number of each name that is taken (1 without a suffix). Names are worked out once
    and written. Names with up to `block` files and taken numbers meet in one shuffle; those in a bucket
    of hashes that holds more are numbered in blocks.
    """
    keys = ["client", "folder", "stem", "ext"]
    named = stage(rows.withColumns({
        "folder": archive_folder(F.col("purchase_date")),
        "stem": archive_stem(F.col("purchase_date"), F.col("merchant"), F.col("gross_amount")),
        "ext": extension(F.col("source_path")),
    }).withColumn("already_in_place", F.expr(
        "regexp_extract(source_path, '([^/]+)/[^/]+$', 1) = folder "
        "AND startswith(regexp_extract(source_path, '([^/]+)$', 1), stem)")), "archive-named")
    both = named.filter("NOT already_in_place").withColumns({"_at": F.col("seq").cast("bigint"), "_taken": F.lit(0)})
    if archived is not None:
        taken = stage(archived.select(*keys, F.col("n").cast("bigint").alias("_at")), "archive-taken")
        both = both.unionByName(taken.withColumn("_taken", F.lit(1)), allowMissingColumns=True)
    # A name that lacks a part is not given out.
    both = both.dropna(subset=[*keys, "_at"]).withColumn("_hash", F.xxhash64(*keys))
    bucket = F.pmod("_hash", F.lit(NAMING_BUCKETS))
    large = [r[0] for r in both.groupBy(bucket.alias("_bucket")).count().filter(F.col("count") > block).collect()]
    if large:
        placed = _numbers_at_once(both.filter(~bucket.isin(large)), keys).unionByName(
            _numbers_in_blocks(both.filter(bucket.isin(large)), keys))
    else:
        placed = _numbers_at_once(both, keys)
    placed = placed.withColumn("file_path", F.expr(
        "concat(folder, '/', stem, if(n > 1, concat('-', n), ''), '.', ext)")).drop("n", "_at", "_taken", "_hash", "_place", "_skips")
    kept = named.filter("already_in_place").withColumn("file_path", F.col("source_path"))
    return placed.unionByName(kept)


# Before the j-th taken number t lie t - j free ones; the k-th new file skips all that come before it,
# the j with t - j < k.
def _numbers_at_once(both: DataFrame, keys: list[str]) -> DataFrame:
    """The number of each new file. A repeated taken number counts once; at equal places a file comes first.
    One shuffle by the hash serves both windows; it goes before the parts of the name, so that most comparisons
    of a sort end there."""
    name = Window.partitionBy("_hash", *keys)
    order = Window.partitionBy("_hash", *keys, "_taken").orderBy("_at")
    placed = both.repartition("_hash").withColumns({
        "_place": F.when(F.col("_taken") == 0, F.row_number().over(order)).otherwise(F.col("_at") - F.dense_rank().over(order)),
        "_skips": F.when((F.col("_taken") == 1) & (F.row_number().over(order) == 1), 1).when(
            (F.col("_taken") == 1) & (F.lag("_at").over(order) < F.col("_at")), 1).otherwise(0)})
    skipped = F.sum("_skips").over(name.orderBy("_place", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("n", F.col("_place") + skipped).filter("_taken = 0")


def _numbers_in_blocks(both: DataFrame, keys: list[str]) -> DataFrame:
    """As `_numbers_at_once`, for names of any size."""
    moving = numbered(both.filter("_taken = 0"), keys, "_at", "_place").withColumn("_skips", F.lit(0))
    taken = numbered(both.filter("_taken = 1").select(*keys, "_at").distinct(), keys, "_at", "_j").select(
        *keys, (F.col("_at") - F.col("_j")).alias("_place"))
    return counted_before(moving, taken, keys, "_place", "_skip").withColumn("n", F.col("_place") + F.col("_skip")).drop("_skip")


def review_reasons(rows: DataFrame, home_currency: str = "GBP", round_from: int = 100) -> DataFrame:
    """Reasons that force a review, as far as columns decide them.

    Uses gross_amount, purchase_date, currency, category, confidence and, where present,
    date_ambiguous, duplicate_of, tax_number, tax_amount, items and personal.
    """
    def col(name: str, default: str) -> str:
        return name if name in rows.columns else default

    reasons = {
        "no_gross": "gross_amount IS NULL",
        "no_date": "purchase_date IS NULL",
        "ambiguous_date": col("date_ambiguous", "false"),
        "foreign_currency": f"currency <> '{home_currency}'",
        "suspected_duplicate": f"{col('duplicate_of', 'NULL')} IS NOT NULL",
        "personal_spending": col("personal", "false"),
        "uncategorised": "coalesce(category, '') IN ('', 'Uncategorised')",
        "refund": "gross_amount < 0",
        "tax_without_number": f"{col('tax_amount', '0')} > 0 AND coalesce({col('tax_number', 'NULL')}, '') = ''"
        if "tax_number" in rows.columns else "false",
        "round_total_no_items": (f"gross_amount >= {round_from} AND gross_amount = floor(gross_amount) "
                                 f"AND coalesce({col('items', '1')}, 0) = 0"),
        "low_confidence": f"confidence < {REVIEW_CONFIDENCE}",
    }
    array = ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in reasons.items())
    return rows.withColumn("reasons", F.expr(f"array_compact(array({array}))"))


def whitelist_matches(rows: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Client and merchant pairs that an approved vendor's name covers.

    A vendor matches when its words, without corporate suffix, appear as consecutive words of the
    merchant text. Merchants and vendors meet at the vendor's word that is rarest in the client's merchant
    texts; there the other words are compared. So a text costs a row per word, whatever the length of the
    longest name, and a name of common words is looked up by its least common one.
    """
    suffixes = "|".join([*LEGAL_SUFFIXES, "us", "uk"])
    words = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' '))"
    name = f"trim(regexp_replace({words.format('vendor')}, '( ({suffixes}))+$', ''))"
    vendors = stage(whitelist.select("client", F.expr(name).alias("name")).filter("name <> ''").distinct().select(
        "client", F.split("name", " ").alias("v")), "vendors")
    merchants = rows.select("client", "merchant").distinct().select(
        "client", "merchant", F.split(F.expr(words.format("merchant")), " ").alias("w"))
    places = stage(merchants.select("client", "merchant", "w", F.posexplode("w").alias("at", "word")), "merchant-words")
    listed = vendors.select("client", "v", F.posexplode("v").alias("offset", "word"))
    # Only words of vendor names are counted, in one row each.
    common = places.join(listed.select("client", "word").distinct(), ["client", "word"], "left_semi").groupBy(
        "client", "word").agg(F.count("*").alias("n"))
    # A name with a word that occurs nowhere matches nowhere.
    index = listed.join(common, ["client", "word"], "left").groupBy("client", "v").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest")).filter("rarest.n > 0").select(
        "client", "v", "rarest.word", "rarest.offset")
    found = places.join(stage(index, "vendor-index"), ["client", "word"]).filter(
        "at >= offset AND slice(w, at - offset + 1, size(v)) = v")
    return found.select("client", "merchant").distinct()


def cleared_reasons(rows: DataFrame, approved: DataFrame) -> DataFrame:
    """An approved vendor clears questions about the vendor, never about the reading."""
    clearable = ", ".join(f"'{r}'" for r in CLEARABLE_REASONS)
    marked = join_unique(rows, approved.withColumn("approved", F.lit(True)), ["client", "merchant"])
    return marked.withColumn("approved", F.coalesce("approved", F.lit(False))).withColumn(
        "open_reasons", F.expr(f"if(approved, array_except(reasons, array({clearable})), reasons)")
    ).withColumn("needs_review", F.size("open_reasons") > 0)


def unlisted_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows whose category is not in the client's closed list."""
    return rows.join(categories.select("client", "category"), ["client", "category"], "left_anti")


def category_deviations(rows: DataFrame, order: str = "line", width: int = 1_000_000) -> DataFrame:
    """Rows booked under another category than the merchant had had until then.

    The usual category of a row is the most frequent one of the merchant's earlier rows, by the order
    of the ledger; the first name of several. Counts only grow, so the highest count that any earlier
    row brought its category to is that of the usual one. `order` is a whole number, unique per client.
    """
    keyed = rows.withColumn("merchant_key", merchant_key(F.col("merchant")))
    merchant = ["client", "merchant_key"]
    # Rows without a category say nothing about the usual one and deviate from none.
    known = numbered(keyed.filter("category IS NOT NULL"), [*merchant, "category"], order, "_nth", width)
    reached = known.withColumn("_reached", F.struct((-F.col("_nth")).alias("n"), "category"))
    seen = least_before(reached, merchant, order, "_reached", "_usual", width)
    return seen.withColumn("usual_category", F.col("_usual.category")).drop("_nth", "_reached", "_usual").filter(
        "category <> usual_category")


def _counts_as_receipt(files: DataFrame) -> str:
    """SQL text: hidden files and the run's own files are no receipts."""
    artefacts = ", ".join(f"'{a}'" for a in RUN_ARTEFACTS)
    name = "regexp_extract(path, '([^/]+)$', 1)"
    own = f"{name} IN ({artefacts})"
    if "top_level" in files.columns:
        own = f"coalesce(top_level, false) AND {own}"
    return f"NOT startswith({name}, '.') AND NOT ({own})"


def missing_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows whose file is absent from their client's archive, or not named."""
    return ledger.withColumn("path", F.col("file_path")).join(
        files.select("client", "path"), ["client", "path"], "left_anti").drop("path")


def orphan_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Archived files without a ledger row of their client; hidden files and the run's own files do
    not count."""
    return files.filter(_counts_as_receipt(files)).join(
        ledger.select("client", F.col("file_path").alias("path")), ["client", "path"], "left_anti")


def audit(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Per client: rows, missing and orphan counts, and whether all agree.

    Paths are resolved inside one client's archive. Both sides shrink to one row per client and path
    and meet in one outer join; a row without a path matches nothing.
    """
    booked = ledger.groupBy("client", F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    archived = files.groupBy("client", "path").agg(
        F.count_if(F.expr(_counts_as_receipt(files))).alias("receipts"), F.lit(True).alias("there"))
    return booked.join(archived, ["client", "path"], "full_outer").groupBy("client").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("receipts"))), F.lit(0)).alias("orphans"),
    ).withColumn("clean", (F.col("missing") == 0) & (F.col("orphans") == 0))


def pending(inbox: DataFrame, booked: DataFrame, reported: DataFrame) -> DataFrame:
    """Inbox files of a client neither booked nor reported in this run."""
    done = booked.select("client", "path").unionByName(reported.select("client", "path"))
    return inbox.join(done, ["client", "path"], "left_anti")


def client_of(path: str) -> str:
    """SQL text: the client project a path belongs to, null outside an accounting folder."""
    return f"nullif(regexp_extract({path}, '^(.*?)/?accounting/', 1), '')"


def cross_filed(rows: DataFrame) -> DataFrame:
    """Rows whose source, ledger and archive do not belong to one client.

    Only a source inside a receipts folder names a client; a file from elsewhere is allowed.
    """
    source = "nullif(regexp_extract(source_path, '^(.*?)/?accounting/receipts/', 1), '')"
    sides = rows.withColumns({
        "source_client": F.expr(source), "ledger_client": F.expr(client_of("ledger_path")),
        "archive_client": F.expr(client_of("archive_path")),
    })
    return sides.withColumn("reject_reason", F.expr(
        "CASE WHEN ledger_client <> archive_client THEN 'ledger and archive differ' "
        "WHEN source_client <> coalesce(ledger_client, archive_client) "
        "THEN 'receipt of another client' END")).filter("reject_reason IS NOT NULL")


def rows_since(ledger: DataFrame, since: str) -> DataFrame:
    """Rows processed at or after a time; blank or malformed stamps drop out."""
    stamp = "try_to_timestamp(CAST(processed_at AS STRING))"
    return ledger.filter(f"{stamp} >= to_timestamp('{since}')")


def totals_by_currency(rows: DataFrame) -> DataFrame:
    """Gross per client and currency. Amounts that are no number drop out of the sum."""
    return rows.withColumn("currency", currency_code(F.col("currency"))).groupBy(
        "client", "currency").agg(
        F.sum(F.col("gross_amount").try_cast("decimal(18,2)")).alias("total"),
        F.count("*").alias("receipts"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row per client: receipts, flagged rows, amounts and the message for the run.

    A client books in a handful of currencies, which bounds the joined list of amounts.
    """
    counts = rows.groupBy("client").agg(
        F.count("*").alias("receipts"), F.count_if("needs_review").alias("flagged"))
    amounts = totals_by_currency(rows).filter("total IS NOT NULL").groupBy("client").agg(
        F.sort_array(F.collect_list(F.struct(
            "currency", F.expr(ledger_amount("currency", "total")).alias("text")))).alias("parts"))
    joined = counts.join(amounts, "client", "left").withColumn(
        "texts", F.expr("transform(parts, p -> p.text)"))
    money_text = ("CASE WHEN size(texts) <= 1 THEN array_join(texts, '') "
                  "ELSE concat(array_join(slice(texts, 1, size(texts) - 1), ', '), ' and ', "
                  "element_at(texts, -1)) END")
    return joined.withColumn("message", F.expr(
        f"concat(receipts, if(receipts = 1, ' receipt', ' receipts'), "
        f"' processed and logged — ', {money_text}, ' total.')")).drop("parts", "texts")


def review_list(rows: DataFrame) -> DataFrame:
    """Flagged rows of a run with what a reader needs to settle them."""
    return rows.filter("needs_review").selectExpr(
        "client", "coalesce(nullif(merchant, ''), 'unknown merchant') AS merchant",
        "purchase_date", "currency", "gross_amount", "confidence",
        "coalesce(nullif(review_notes, ''), 'no reason recorded') AS review_notes",
        "coalesce(nullif(file_path, ''), 'no file path') AS file_path")
