"""Registered queries over the expense ledger, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ledger
from tidemark.session import fresh_path
from tidemark.streaming import inbox

from . import sqlgen as g
from .views import LEDGER_SQL, booked_receipts, table

QUERIES = {}
ORACLE = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


# --- row checks -----------------------------------------------------------------------------

RAW_SQL = """raw AS (SELECT o_orderkey AS seq,
    CASE WHEN o_orderkey % 17 = 0 THEN '03/04/2026' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
    CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE '£' || printf('%.2f', o_totalprice) END AS gross_text,
    CAST(o_totalprice AS DECIMAL(18,2)) AS g0,
    CASE o_orderkey % 11 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + 1 ELSE CAST(floor(o_totalprice / 6) AS DECIMAL(18,2)) END AS tax0,
    CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS net_off, o_orderkey % 19 = 0 AS tax_off, o_orderkey % 23 = 0 AS net_bad, o_orderkey % 29 = 0 AND o_orderkey % 11 <> 0 AS tie, 0.55 + (o_orderkey % 60) / 100.0 AS conf0, o_orderkey % 5 = 0 AS has_note
  FROM orders)"""


@register("l1_l2_p24_p35_row_checks", g.with_(RAW_SQL) + """
SELECT seq, CASE WHEN seq % 17 = 0 THEN 'date is not ISO' WHEN seq % 13 = 0 THEN 'gross is not a number'
    WHEN tax_off THEN 'tax is not a number' WHEN net_bad THEN 'net is not a number' WHEN net_off = 1 THEN 'arithmetic does not reconcile' WHEN tax0 > g0 THEN 'tax exceeds gross'
    WHEN conf0 > 1 THEN 'confidence outside 0..1' WHEN conf0 < 0.70 AND NOT has_note THEN 'flag without a note' END AS reject_reason,
  CASE WHEN seq % 13 <> 0 THEN g0::DOUBLE END AS gross, CASE WHEN NOT tax_off THEN tax0 + CASE WHEN tie THEN 0.02 ELSE 0 END END::DOUBLE AS tax, conf0 < 0.70 AS needs_review FROM raw""")
def l1_l2_row_checks(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seq", "IF(o_orderkey % 17 = 0, '03/04/2026', date_format(o_orderdate, 'yyyy-MM-dd')) AS purchase_date",
        "IF(o_orderkey % 13 = 0, 'n/a', '£' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) AS gross_amount",
        # A tie of half a cent goes to the even cent: tax + 0.015 is tax + 0.02, and + 0.025 is too.
        """IF(o_orderkey % 19 = 0, 'eight', CAST(IF(o_orderkey % 11 = 0, CAST(o_totalprice AS DECIMAL(18,2)) + 1, CAST(floor(o_totalprice / 6) AS DECIMAL(18,2)))
            + IF(o_orderkey % 29 = 0 AND o_orderkey % 11 <> 0, IF(o_orderkey % 2 = 0, 0.015, 0.025), 0) AS STRING)) AS tax_amount""",
        """IF(o_orderkey % 23 = 0, 'forty', IF(o_orderkey % 7 = 0, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 5 AS STRING), NULL)) AS net_amount""",
        "CAST(0.55 + (o_orderkey % 60) / 100.0 AS STRING) AS confidence", "false AS needs_review",
        "IF(o_orderkey % 5 = 0, 'checked', '') AS review_notes", "'gbp ' AS currency")
    return ledger.check_rows(raw).select("seq", "reject_reason", F.col("gross_amount").cast("double").alias("gross"),
                                         F.col("tax_amount").cast("double").alias("tax"), "needs_review")


@register("p29_tax_from_rate", """SELECT k, ((2 * c * r + d) // (2 * d))::DOUBLE / 100.0 AS tax
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 100 + r ELSE 100 END AS d FROM (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) AS c,
    CASE o_orderkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 ELSE 25 END AS r FROM orders))""")
def p29_tax_from_rate(spark, sf):
    o = table(spark, sf, "orders").withColumn("r", F.expr("CASE o_orderkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 5 ELSE 25 END"))
    tax = ledger.tax_from_rate(F.expr("CAST(o_totalprice AS DECIMAL(12,2))"), F.col("r"), F.col("o_orderkey") % 2 == 0)
    return o.select(F.col("o_orderkey").alias("k"), tax.cast("double").alias("tax"))


# --- duplicates -----------------------------------------------------------------------------

COARSE = """coarse AS (SELECT client, line, merchant, CAST(date_trunc('month', purchase_date) AS DATE) AS purchase_date,
    CAST(floor(gross_amount / 100000) * 100000 AS DECIMAL(18,2)) AS gross_amount, receipt_number, lower(regexp_replace(lower(merchant), '[^a-z0-9]', '', 'g')) AS mk,
    nullif(lower(trim(receipt_number)), '') AS nk FROM booked)"""


def coarse(spark, sf):
    """Receipts on whole months and hundred thousands, so that look-alikes are common."""
    return booked_receipts(spark, sf).selectExpr(
        "client", "line", "merchant", "CAST(trunc(purchase_date, 'MM') AS DATE) AS purchase_date",
        "CAST(floor(gross_amount / 100000) * 100000 AS DECIMAL(18,2)) AS gross_amount", "receipt_number")


@register("j8_l5_find_duplicates", g.with_(LEDGER_SQL, COARSE, """
old AS (SELECT * FROM coarse WHERE purchase_date < DATE '2000-01-01'), new AS (SELECT * FROM coarse WHERE purchase_date >= DATE '1999-06-01'),
a AS (SELECT client, mk, nk, min(line) AS np FROM old WHERE nk IS NOT NULL GROUP BY ALL),
b AS (SELECT client, mk, purchase_date, gross_amount, min(line) AS ap FROM old GROUP BY ALL)""") + """
SELECT new.line AS seq, CASE WHEN np IS NULL THEN ap WHEN ap IS NULL THEN np ELSE least(np, ap) END AS duplicate_of,
  CASE WHEN np <= coalesce(ap, np) THEN 'same receipt number' WHEN ap IS NOT NULL THEN 'same date and gross amount' END AS duplicate_reason
FROM new LEFT JOIN a USING (client, mk, nk) LEFT JOIN b USING (client, mk, purchase_date, gross_amount)""")
def j8_l5_find_duplicates(spark, sf):
    rows = coarse(spark, sf)
    batch = rows.filter("purchase_date >= DATE '1999-06-01'").withColumnRenamed("line", "seq")
    return ledger.find_duplicates(batch, rows.filter("purchase_date < DATE '2000-01-01'")).select(
        "seq", "duplicate_of", "duplicate_reason")


FIRST = """SELECT line AS seq FROM (SELECT line, nullif(receipt_number, '') AS nk, row_number() OVER (PARTITION BY client, merchant, receipt_number ORDER BY line) AS rn
  FROM booked) WHERE nk IS NULL OR rn = 1"""


@register("l6_batch_duplicates", g.with_(LEDGER_SQL) + FIRST)
def l6_batch_duplicates(spark, sf):
    """Exact dates and amounts never repeat here, so the first row of each number is the one written."""
    rows = booked_receipts(spark, sf).withColumnRenamed("line", "seq").withColumns({"force": F.lit(False), "review_notes": F.lit("")})
    none = booked_receipts(spark, sf).filter("false")
    return ledger.file_batch(rows, none).filter("state = 'written'").select("seq")


@register("st2_inbox_to_ledger", g.with_(LEDGER_SQL) + FIRST)
def st2_inbox_to_ledger(spark, sf):
    """The order table arrives as a stream of receipts and is filed into an empty ledger."""
    stream = spark.readStream.schema(table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    rows = stream.join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    arrivals = rows.selectExpr(
        "n_name AS client", "c_name AS merchant", "IF(o_orderkey % 4 = 0, '', 'R-' || o_custkey || '-' || substr(o_orderpriority, 1, 1)) AS receipt_number",
        "CAST(o_orderdate AS DATE) AS purchase_date", "CAST(o_totalprice AS DECIMAL(18,2)) AS gross_amount", "'in/' || o_orderkey || '.jpg' AS source_path",
        "o_orderkey AS seq", "CAST(o_orderdate AS TIMESTAMP) AS arrived_at")
    path = fresh_path(spark, "stream-ledger")
    inbox.start(arrivals, path, fresh_path(spark, "stream-ledger-checkpoint")).awaitTermination()
    return inbox.read_ledger_table(spark, path).select(F.col("line").alias("seq"))


FILED = """
old AS (SELECT * FROM coarse WHERE purchase_date < DATE '2000-01-01'),
a AS (SELECT client, mk, nk, min(line) AS np FROM old WHERE nk IS NOT NULL GROUP BY ALL),
b AS (SELECT client, mk, purchase_date, gross_amount, min(line) AS ap FROM old GROUP BY ALL),
r AS (SELECT client, mk, nk, purchase_date || '|' || gross_amount AS ak, line AS seq, np, ap,
    row_number() OVER (PARTITION BY client, mk ORDER BY line) AS rn
  FROM coarse LEFT JOIN a USING (client, mk, nk) LEFT JOIN b USING (client, mk, purchase_date, gross_amount)
  WHERE purchase_date >= DATE '2000-01-01'),
step AS (
  SELECT client, mk, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS state,
    CAST(NULL AS BIGINT) AS duplicate_of, CAST(NULL AS VARCHAR) AS duplicate_reason, CAST(NULL AS BOOLEAN) AS duplicate_in_batch,
    CAST([] AS VARCHAR[]) AS numbers, CAST([] AS VARCHAR[]) AS amounts, CAST([] AS BIGINT[]) AS seqs
  FROM (SELECT DISTINCT client, mk FROM r)
  UNION ALL
  SELECT client, mk, rn, seq, CASE WHEN old_hit IS NULL AND new_hit IS NULL THEN 'written' ELSE 'duplicate' END,
    coalesce(old_hit, new_hit),
    CASE WHEN old_hit IS NOT NULL THEN CASE WHEN np <= coalesce(ap, np) THEN 'same receipt number' ELSE 'same date and gross amount' END
         WHEN new_hit IS NOT NULL THEN CASE WHEN nb <= coalesce(ab, nb) THEN 'same receipt number' ELSE 'same date and gross amount' END END,
    CASE WHEN old_hit IS NOT NULL THEN false WHEN new_hit IS NOT NULL THEN true END,
    CASE WHEN old_hit IS NULL AND new_hit IS NULL THEN list_append(numbers, coalesce(nk, '')) ELSE numbers END,
    CASE WHEN old_hit IS NULL AND new_hit IS NULL THEN list_append(amounts, ak) ELSE amounts END,
    CASE WHEN old_hit IS NULL AND new_hit IS NULL THEN list_append(seqs, seq) ELSE seqs END
  FROM (
    SELECT r.*, s.numbers, s.amounts, s.seqs, least(np, ap) AS old_hit, s.seqs[list_position(s.numbers, nk)] AS nb,
      s.seqs[list_position(s.amounts, ak)] AS ab, least(s.seqs[list_position(s.numbers, nk)], s.seqs[list_position(s.amounts, ak)]) AS new_hit
    FROM step s JOIN r ON r.client = s.client AND r.mk = s.mk AND r.rn = s.rn + 1))"""


@register("l6_file_batch", g.with_(LEDGER_SQL, COARSE, FILED).replace("WITH", "WITH RECURSIVE", 1) + """
SELECT seq, state, duplicate_of, duplicate_reason, duplicate_in_batch FROM step WHERE rn > 0""")
def l6_file_batch(spark, sf):
    """The twin files one row of every client and merchant per step, and carries what was written."""
    rows = coarse(spark, sf)
    batch = rows.filter("purchase_date >= DATE '2000-01-01'").withColumnRenamed("line", "seq").withColumns({
        "force": F.lit(False), "review_notes": F.lit("")})
    return ledger.file_batch(batch, rows.filter("purchase_date < DATE '2000-01-01'")).select(
        "seq", "state", "duplicate_of", "duplicate_reason", "duplicate_in_batch")


NAMES = """nm AS (SELECT client, line, strftime(purchase_date, '%Y%m_%B') AS folder, strftime(purchase_date, '%Y-%m-%d') || '_' ||
    rtrim(left(trim(regexp_replace(lower(merchant), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-') || '_' || CAST(gross_amount AS VARCHAR) AS stem FROM coarse),
nn AS (SELECT * REPLACE (CASE length(stem) % 4 WHEN 0 THEN n + 1 WHEN 2 THEN CASE WHEN n = 1 THEN 2 ELSE n + 2 END WHEN 1 THEN CASE WHEN n = 1 THEN 1 ELSE n + 1 END ELSE n END AS n)
  FROM (SELECT *, row_number() OVER (PARTITION BY client, folder, stem ORDER BY line) AS n FROM nm))"""


@register("win9_p27_snk7_archive_names", g.with_(LEDGER_SQL, COARSE, NAMES) + """
SELECT line AS seq, folder, folder || '/' || stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.jpg' AS file_path FROM nn""")
def win9_archive_names(spark, sf):
    rows = coarse(spark, sf).withColumnRenamed("line", "seq").withColumn(
        "source_path", F.concat(F.lit("inbox/"), F.col("seq").cast("string"), F.lit(".JPG")))
    keys = rows.select("client", text.archive_folder(F.col("purchase_date")).alias("folder"),
                       text.archive_stem(F.col("purchase_date"), F.col("merchant"), F.col("gross_amount")).alias("stem"),
                       F.lit("jpg").alias("ext")).distinct()
    # Taken are stem; stem and stem-3; or stem-2 alone: names have gaps.
    taken = keys.withColumn("n", F.explode(F.expr(
        "CASE length(stem) % 4 WHEN 0 THEN array(1) WHEN 2 THEN array(3, 1) WHEN 1 THEN array(2) ELSE array() END")))
    return ledger.archive_names(rows, taken).select("seq", "folder", "file_path")


@register("l9_already_in_place", g.with_(LEDGER_SQL, COARSE, NAMES) + """
SELECT line AS seq, CASE WHEN line % 2 = 0 THEN folder || '/' || stem || '.pdf' ELSE folder || '/' || stem END AS file_path, line % 2 = 0 AS already_in_place
FROM nm WHERE line % 2 = 0""")
def l9_already_in_place(spark, sf):
    rows = coarse(spark, sf).withColumnRenamed("line", "seq")
    placed = rows.withColumn("source_path", F.when(F.col("seq") % 2 == 0, F.concat(
        text.archive_folder(F.col("purchase_date")), F.lit("/"),
        text.archive_stem(F.col("purchase_date"), F.col("merchant"), F.col("gross_amount")), F.lit(".pdf"))
    ).otherwise(F.concat(F.lit("inbox/"), F.col("seq").cast("string"), F.lit(".pdf"))))
    return ledger.archive_names(placed).filter("already_in_place").select("seq", "file_path", "already_in_place")


# --- review ---------------------------------------------------------------------------------

REV = """rv AS (SELECT client, line, merchant, CASE n WHEN '' THEN '???' ELSE upper(n) END AS currency, gross_amount, category, confidence, line % 5 AS items,
    CASE WHEN line % 3 = 0 THEN '' ELSE 'T1' END AS tax_number FROM (SELECT *, trim(currency) AS n FROM booked)),
rs AS (SELECT *, list_filter([CASE WHEN currency <> 'GBP' THEN 'foreign_currency' END, CASE WHEN category = '5-LOW' THEN 'uncategorised' END,
    CASE WHEN tax_number = '' THEN 'tax_without_number' END, CASE WHEN gross_amount >= 100 AND gross_amount = floor(gross_amount) AND items = 0 THEN 'round_total_no_items' END,
    CASE WHEN confidence < 0.70 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS reasons,
  regexp_matches(merchant, '[05]$') AS approved FROM rv)"""


def reviewed(spark, sf):
    rows = booked_receipts(spark, sf).withColumns({
        "currency": text.currency_code(F.col("currency")),
        "category": F.expr("IF(category = '5-LOW', 'Uncategorised', category)"),
        "items": F.expr("line % 5"), "tax_number": F.expr("IF(line % 3 = 0, '', 'T1')"), "tax_amount": F.lit(1)})
    return ledger.review_reasons(rows)


def vendors(spark, sf):
    rows = booked_receipts(spark, sf).filter("merchant RLIKE '[05]$'")
    return rows.select("client", F.concat(F.upper(F.replace("merchant", F.lit("#"), F.lit(" "))), F.lit(", Ltd.")).alias("vendor")).distinct()


@register("l3_review_reasons", g.with_(LEDGER_SQL, REV) + "SELECT line, array_to_string(reasons, ',') AS reasons FROM rs")
def l3_review_reasons(spark, sf):
    return reviewed(spark, sf).select("line", F.array_join("reasons", ",").alias("reasons"))


@register("j11_whitelist_matches", g.with_(LEDGER_SQL) + "SELECT DISTINCT client, merchant FROM booked WHERE regexp_matches(merchant, '[05]$')")
def j11_whitelist_matches(spark, sf):
    return ledger.whitelist_matches(booked_receipts(spark, sf), vendors(spark, sf))


@register("l4_cleared_reasons", g.with_(LEDGER_SQL, REV) + """
SELECT line, approved, array_to_string(CASE WHEN approved THEN list_filter(reasons, lambda x: x NOT IN ('personal_spending', 'tax_without_number', 'round_total_no_items'))
  ELSE reasons END, ',') AS open_reasons FROM rs""")
def l4_cleared_reasons(spark, sf):
    rows = reviewed(spark, sf)
    return ledger.cleared_reasons(rows, ledger.whitelist_matches(rows, vendors(spark, sf))).select(
        "line", "approved", F.array_join("open_reasons", ",").alias("open_reasons"))


@register("j12_unlisted_categories", g.with_(LEDGER_SQL) + """
SELECT line, category FROM booked WHERE (client, category) NOT IN (SELECT n_name, c FROM nation, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS c))""")
def j12_unlisted_categories(spark, sf):
    listed = table(spark, sf, "nation").select(
        F.col("n_name").alias("client"), F.explode(F.array(*[F.lit(c) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM")])).alias("category"))
    return ledger.unlisted_categories(booked_receipts(spark, sf), listed).select("line", "category")


@register("l10_category_deviations", g.with_(LEDGER_SQL) + """, h AS (SELECT a.line, a.category, b.category AS earlier, count(*) AS n
  FROM booked a JOIN booked b ON b.client = a.client AND b.merchant = a.merchant AND b.line < a.line GROUP BY ALL),
u AS (SELECT line, category, earlier AS usual_category FROM h QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, earlier) = 1)
SELECT line, category, usual_category FROM u WHERE category <> usual_category""")
def l10_category_deviations(spark, sf):
    return ledger.category_deviations(booked_receipts(spark, sf)).select("line", "category", "usual_category")


@register("j15_client_guard", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 1 THEN 'ledger and archive differ' ELSE 'receipt of another client' END AS reject_reason
FROM orders WHERE o_orderkey % 6 = 1 OR (o_orderkey % 6 <> 1 AND o_orderkey % 4 = 2)""")
def j15_client_guard(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k",
        """CASE o_orderkey % 4 WHEN 0 THEN '/home/Downloads/' || o_orderkey || '.jpg' WHEN 2 THEN '/clients/other/accounting/receipts/' || o_orderkey || '.jpg'
           ELSE '/clients/c' || o_custkey || '/accounting/receipts/' || o_orderkey || '.jpg' END AS source_path""",
        "'/clients/c' || o_custkey || '/accounting/expenses.csv' AS ledger_path",
        """IF(o_orderkey % 6 = 1, '/clients/elsewhere', '/clients/c' || o_custkey) || '/accounting/receipts/_processed-receipts' AS archive_path""")
    return ledger.cross_filed(rows).select("k", "reject_reason")


# --- audit and run --------------------------------------------------------------------------

# Clients share paths: every client counts its receipts anew.
SHARED = """filed AS (SELECT * REPLACE ('receipts/' || (line % 500) || '-' || (line % 3) || '.jpg' AS file_path) FROM booked)"""
FILES = SHARED + """, files AS (SELECT DISTINCT n_name AS client, 'receipts/' || (l_orderkey % 500) || '-' || l_linenumber || '.jpg' AS path FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def files(spark, sf):
    t = lambda n: table(spark, sf, n)
    return (t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey"))
            .join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
            .selectExpr("n_name AS client", "'receipts/' || (l_orderkey % 500) || '-' || l_linenumber || '.jpg' AS path").distinct())


def filed_receipts(spark, sf):
    return booked_receipts(spark, sf).withColumn("file_path", F.expr("'receipts/' || (line % 500) || '-' || (line % 3) || '.jpg'"))


@register("j9_missing_files", g.with_(LEDGER_SQL, FILES) + "SELECT line, file_path FROM filed WHERE (client, file_path) NOT IN (SELECT (client, path) FROM files)")
def j9_missing_files(spark, sf):
    return ledger.missing_files(filed_receipts(spark, sf), files(spark, sf)).select("line", "file_path")


@register("j10_u6_orphan_files", g.with_(LEDGER_SQL, FILES) + "SELECT client, path FROM files WHERE (client, path) NOT IN (SELECT (client, file_path) FROM filed)")
def j10_u6_orphan_files(spark, sf):
    return ledger.orphan_files(files(spark, sf), filed_receipts(spark, sf)).select("client", "path")


@register("l7_audit", g.with_(LEDGER_SQL, FILES) + """, r AS (SELECT client, count(*) AS rows FROM filed GROUP BY 1),
m AS (SELECT client, count(*) AS missing FROM filed WHERE (client, file_path) NOT IN (SELECT (client, path) FROM files) GROUP BY 1),
o AS (SELECT client, count(*) AS orphans FROM files WHERE (client, path) NOT IN (SELECT (client, file_path) FROM filed) GROUP BY 1)
SELECT client, coalesce(rows, 0) AS rows, coalesce(missing, 0) AS missing, coalesce(orphans, 0) AS orphans,
  coalesce(missing, 0) = 0 AND coalesce(orphans, 0) = 0 AS clean FROM r FULL JOIN m USING (client) FULL JOIN o USING (client)""")
def l7_audit(spark, sf):
    return ledger.audit(filed_receipts(spark, sf), files(spark, sf))


@register("j16_pending", g.with_(LEDGER_SQL, FILES) + """SELECT client, path FROM files WHERE (client, path) NOT IN (SELECT (client, file_path) FROM filed) AND path NOT LIKE '%-2.jpg'""")
def j16_pending(spark, sf):
    inbox = files(spark, sf)
    booked = filed_receipts(spark, sf).select("client", F.col("file_path").alias("path"))
    return ledger.pending(inbox, booked, inbox.filter("path LIKE '%-2.jpg'")).select("client", "path")


@register("a16_p32_totals_by_currency", g.with_(LEDGER_SQL) + """SELECT client, CASE WHEN trim(currency) = '' THEN '???' ELSE upper(trim(currency)) END AS currency,
  CAST(sum(gross_amount) AS DOUBLE) AS total, count(*) AS receipts FROM booked GROUP BY 1, 2""")
def a16_totals_by_currency(spark, sf):
    return ledger.totals_by_currency(booked_receipts(spark, sf)).withColumn("total", F.col("total").cast("double"))


@register("f7_rows_since", g.with_(LEDGER_SQL) + "SELECT line FROM booked WHERE line % 9 > 1 AND processed_at >= TIMESTAMP '2000-03-01 00:00:00'")
def f7_rows_since(spark, sf):
    rows = booked_receipts(spark, sf).withColumn("processed_at", F.expr(
        "CASE line % 9 WHEN 0 THEN '' WHEN 1 THEN 'not a time' ELSE CAST(processed_at AS STRING) END"))
    return ledger.rows_since(rows, "2000-03-01 00:00:00").select("line")


@register("a17_l8_run_summary", g.with_(LEDGER_SQL) + """, s AS (SELECT *, CASE WHEN trim(currency) = '' THEN '???' ELSE upper(trim(currency)) END AS cur FROM booked
  WHERE processed_at >= TIMESTAMP '2000-03-01 00:00:00'), c AS (SELECT client, count(*) AS receipts, count(*) FILTER (confidence < 0.70) AS flagged FROM s GROUP BY 1),
a AS (SELECT client, any_value(cur) AS cur, sum(gross_amount) AS total FROM s GROUP BY client)
SELECT client, receipts, flagged, receipts || CASE WHEN receipts = 1 THEN ' receipt' ELSE ' receipts' END || ' processed and logged — ' ||
  CASE cur WHEN 'GBP' THEN '£' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' ELSE '' END || format('{:,.2f}', total::DOUBLE) || CASE cur WHEN '???' THEN ' ???' ELSE '' END || ' total.' AS message
FROM c JOIN a USING (client)""")
def a17_l8_run_summary(spark, sf):
    rows = booked_receipts(spark, sf).withColumn("needs_review", F.expr("confidence < 0.70"))
    return ledger.run_summary(ledger.rows_since(rows, "2000-03-01 00:00:00"))


@register("snk8_review_list", g.with_(LEDGER_SQL) + """SELECT client, merchant, CAST(purchase_date AS VARCHAR) AS purchase_date, gross_amount::DOUBLE AS gross_amount,
  CASE WHEN line % 2 = 0 THEN 'no reason recorded' ELSE 'blurred' END AS review_notes, file_path FROM booked WHERE confidence < 0.70""")
def snk8_review_list(spark, sf):
    rows = booked_receipts(spark, sf).withColumns({
        "needs_review": F.expr("confidence < 0.70"), "review_notes": F.expr("IF(line % 2 = 0, '', 'blurred')")})
    return ledger.review_list(rows).select("client", "merchant", F.col("purchase_date").cast("string").alias("purchase_date"),
                                           F.col("gross_amount").cast("double").alias("gross_amount"), "review_notes", "file_path")
