import random
import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.catalog import LEDGER_COLUMNS
from tidemark.operators import aggregate, ledger
from tidemark.operators.components import components
from tidemark.plans import ledger_run
from tidemark.sources import exports, files

ROW = "client string, seq bigint, merchant string, receipt_number string, purchase_date date, gross_amount decimal(18,2), force boolean, review_notes string"
OLD = "client string, line bigint, merchant string, receipt_number string, purchase_date date, gross_amount decimal(18,2)"


def key(m):
    return "".join(c for c in m.lower() if c.isascii() and c.isalnum())


def brute(batch, old):
    """File rows one at a time, the way a person with the ledger open would. Batch rows are (1, seq)."""
    books = [((0, line), c, key(m), (n or "").strip().lower(), d, g) for c, line, m, n, d, g in old]
    out = {}
    for c, seq, m, n, d, g, force, _ in batch:
        number, hit = (n or "").strip().lower(), None
        for pos, c2, m2, n2, d2, g2 in books:
            if c2 != c or m2 != key(m):
                continue
            if number and n2 == number:
                hit = (pos, "same receipt number")
                break
            if d2 == d and g2 == g:
                hit = (pos, "same date and gross amount")
                break
        state = "duplicate" if hit and not force else "written"
        if state == "written":
            books.append(((1, seq), c, key(m), number, d, g))
        out[seq] = (state, *((hit[0][1], hit[1], hit[0][0] == 1) if hit else (None, None, None)))
    return out


def filed(spark, batch, old, **options):
    got = ledger.file_batch(spark.createDataFrame(batch, ROW), spark.createDataFrame(old, OLD), **options).collect()
    return {r["seq"]: (r["state"], r["duplicate_of"], r["duplicate_reason"], r["duplicate_in_batch"]) for r in got}


@pytest.mark.parametrize(("seed", "rounds"), [(1, 6), (2, 1), (3, 0)])
def test_batch_is_filed_like_one_at_a_time(spark, seed, rounds):
    rng = random.Random(seed)

    def row():
        return (rng.choice(["Shell", "SHELL ", "Tesco"]), rng.choice(["", None, "A1", "a1 ", "B2", "C3"]),
                date(2026, 3, rng.randint(1, 3)), Decimal(rng.randint(1, 4)))

    # Lines of any size come before the batch, epoch milliseconds too.
    old = [("c1", line, *row()) for line in (2, 5, 1_767_600_000_000)]
    batch = [(rng.choice(["c1", "c2"]), s, *row(), rng.random() < 0.1, "seen") for s in range(80)]
    assert filed(spark, batch, old, rounds=rounds) == brute(batch, old)
    got = ledger.file_batch(spark.createDataFrame(batch, ROW), spark.createDataFrame(old, OLD)).collect()
    forced = [r for r in got if r["force"] and r["duplicate_of"]]
    assert all("forced past" in r["review_notes"] for r in forced)


def test_forced_row_repeats_one_that_settles_later(spark):
    day, other = date(2026, 3, 1), date(2026, 3, 2)
    batch = [("c", 1, "Shell", "a", day, Decimal(1), False, ""), ("c", 2, "Shell", "a", day, Decimal(2), False, ""),
             ("c", 3, "Shell", "b", day, Decimal(2), False, ""), ("c", 4, "Shell", "b", other, Decimal(3), True, "")]
    got = filed(spark, batch, [])
    assert got == brute(batch, []) and got[4] == ("written", 3, "same receipt number", True)


def test_keys_of_one_row_are_not_joined(spark, monkeypatch):
    """Of 400 rows four share a key: two keys are looked up in a round, and for what they repeat."""
    joined, write = [], aggregate.stage
    monkeypatch.setattr(aggregate, "stage", lambda df, name, *more: joined.append(write(df, name, *more)) or joined[-1])
    batch = [("c", i, "Shell", f"n{max(i, 1)}", date(2026, 3, 1), Decimal(min(i, 398)), False, "") for i in range(400)]
    assert filed(spark, batch, []) == brute(batch, [])
    assert 0 < sum(df.count() for df in joined) <= 10


def test_an_empty_ledger_is_not_joined(spark):
    row = ("c", 1, "Shell", "a", date(2026, 3, 1), Decimal(1))
    rows = ledger.with_match_keys(spark.createDataFrame([(*row, False, "")], ROW))
    for lines, joins, found in (([], 0, [0, 0]), ([row[:1] + (7,) + row[2:]], 2, [1, 1])):
        booked = ledger.with_match_keys(spark.createDataFrame(lines, OLD)).withColumn("pos", ledger._position(0, "line"))
        firsts = ledger._firsts_for(rows, booked)
        assert sum("Join" in f._jdf.queryExecution().analyzed().toString() for f in firsts) == joins
        assert [f.count() for f in firsts] == found


def test_long_chain_of_look_alikes(spark):
    # Row i shares its number with row i - 1 or its date and amount with it, by turns.
    batch = [("c", i, "Shell", f"n{(i + 1) // 2}", date(2026, 3, 1), Decimal(i // 2), False, "") for i in range(1200)]
    assert filed(spark, batch, [], rounds=2) == brute(batch, [])


def test_ten_thousand_look_alikes_in_a_chain(spark):
    """As above in an order of its own; every second one is written, whatever the size of a block."""
    batch = [("c", i, "Shell", f"n{(i + 1) // 2}", date(2026, 3, 1), Decimal(i // 2), False, "") for i in range(10_000)]
    batch += [("c", 10_000 + i, "Shell", f"x{i}", date(2026, 4, 1), Decimal(i), False, "") for i in range(500)]
    got = filed(spark, batch, [], rounds=1, block=4000)
    assert {i for i in range(10_000) if got[i][0] == "written"} == set(range(0, 10_000, 2))
    assert all(got[i][1] == i - 1 for i in range(1, 10_000, 2)) and all(got[i][0] == "written" for i in range(10_000, 10_500))


@pytest.mark.parametrize(("seed", "block"), [(4, 20), (6, 35)])
def test_a_group_larger_than_a_block(spark, seed, block):
    rng = random.Random(seed)
    batch = [("c1", s, "Shell", rng.choice(["", None, *"abcdefgh"]), date(2026, 3, rng.randint(1, 4)), Decimal(rng.randint(1, 4)), rng.random() < 0.1, "")
             for s in range(70)]
    batch += [(None, 70, "Shell", "a", date(2026, 3, 1), Decimal(1), False, ""), (None, 71, "Shell", "a", date(2026, 3, 1), Decimal(1), False, "")]
    got = filed(spark, batch, [], rounds=0, block=block)
    assert {k: v for k, v in got.items() if k < 70} == brute(batch[:70], []) and got[70][0] == got[71][0] == "written"


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(1000, 1900)] + [(5000, i) for i in range(4000, 4100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_counted_before(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.randrange(60), i) for i in range(80)] + [("z", 5, 99)]
    marks = [(rng.choice("xyw"), rng.randrange(60)) for _ in range(90)]
    got = aggregate.counted_before(
        spark.createDataFrame(rows, "k string, at bigint, i bigint"), spark.createDataFrame(marks, "k string, at bigint"), ["k"], "at", "before", width=7).collect()
    assert sorted((r.i, r.before) for r in got) == [(i, sum(m == k and t < at for m, t in marks)) for k, at, i in sorted(rows, key=lambda r: r[2])]


def test_a_hot_key_is_split(spark):
    """One key with nine rows of ten: adaptive execution splits it, as the other side is a table."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(400_000, numPartitions=8).selectExpr("if(id % 10 < 9, 0, id) AS k", "id", "uuid() AS pad")
        unique = rows.groupBy("k").agg(F.min("id").alias("first"))
        joined = aggregate.join_unique(rows, unique, ["k"])
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_checks(spark):
    raw = spark.createDataFrame([
        (1, "2026-03-14", "£48.20", "8.03", "40.17", "0.96", False, "", "gbp"),
        (2, "14/03/2026", "48.20", "8.03", None, "0.96", False, "", "GBP"),
        (3, "2026-03-14", "48.20", "8.03", "41.00", "0.96", False, "", "GBP"),
        (4, "2026-03-14", "48.20", "50", None, "0.96", False, "", "GBP"),
        (5, "2026-03-14", "-48.20", "-8.03", None, "0.96", True, "refund", "GBP"),
        (6, "2026-03-14", "48.20", "", None, "1.20", False, "", ""),
        (7, "2026-03-14", "48.20", None, None, "0.60", False, " ", "GBP"),
        (8, "2026-03-14", "48.20", "eight", None, "0.96", False, "", "GBP"),
        (9, "2026-03-14", "48.20", "8.03", "forty", "0.96", False, "", "GBP"),
        (10, "2026-03-14", "1.005", "0.015", None, "0.96", False, "", "GBP"),
    ], "seq int, purchase_date string, gross_amount string, tax_amount string, net_amount string, confidence string, needs_review boolean, review_notes string, currency string")
    got = {r["seq"]: r for r in ledger.check_rows(raw).collect()}
    assert [got[i]["reject_reason"] for i in range(1, 11)] == [
        None, "date is not ISO", "arithmetic does not reconcile", "tax exceeds gross", None,
        "confidence outside 0..1", "flag without a note", "tax is not a number", "net is not a number", None]
    assert (got[10]["gross_amount"], got[10]["tax_amount"]) == (Decimal("1.00"), Decimal("0.02"))
    assert got[1]["net_amount"] == Decimal("40.17") and got[1]["currency"] == "GBP"
    assert got[5]["net_amount"] == Decimal("-40.17") and got[6]["currency"] == "???"


def test_tax_inside_a_printed_total(spark):
    row = spark.range(1).select(
        ledger.tax_from_rate(F.lit(48.20).cast("decimal(10,2)"), F.lit(20), F.lit(True)).alias("i"),
        ledger.tax_from_rate(F.lit(100).cast("decimal(10,2)"), F.lit(20), F.lit(False)).alias("e")).first()
    assert (row["i"], row["e"]) == (Decimal("8.03"), Decimal("20.00"))


def test_whitelist(spark):
    rows = spark.createDataFrame([("c", m) for m in (
        "SEMRUSH*SUBSCRIPTION", "CANVA* I04321", "Tesco Stores 4471", "Tescorp", "Other")], "client string, merchant string")
    listed = spark.createDataFrame([("c", v) for v in ("SEMRush Inc", "Canva US Inc.", "Tesco")] + [("d", "Other")], "client string, vendor string")
    got = {r["merchant"] for r in ledger.whitelist_matches(rows, listed).collect()}
    assert got == {"SEMRUSH*SUBSCRIPTION", "CANVA* I04321", "Tesco Stores 4471"}


def test_whitelist_of_long_names_and_texts(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "x1"]
    vendors = [("c", " ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", " Ltd", " Inc."])) for n in (1, 2, 2, 3, 5, 9, 12) for _ in range(4)]
    vendors += [("c", "never seen"), ("c", "..."), ("d", "alpha")]
    merchants = [("c", rng.choice(["", "* "]) + rng.choice(["-", " ", " & "]).join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    merchants += [("c", v) for _, v in vendors[:20:3]] + [("d", "Alpha!"), ("c", "")]

    def plain(text):
        return re.sub("[^a-z0-9]+", " ", text.lower()).strip()

    listed = {(c, re.sub("( (ltd|inc))+$", "", plain(v))) for c, v in vendors if plain(v)}
    want = {m for m in merchants if any(c == m[0] and f" {v} " in f" {plain(m[1])} " for c, v in listed)}
    got = {tuple(r) for r in ledger.whitelist_matches(
        spark.createDataFrame(merchants, "client string, merchant string"), spark.createDataFrame(vendors, "client string, vendor string")).collect()}
    assert got == want and 20 < len(want) < len(set(merchants))


@pytest.mark.parametrize("width", [1_000_000, 7])
def test_category_deviations_look_back_only(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("cd"), rng.choice(["Shell", "SHELL.", "Tesco"]), rng.choice(["Fuel", "Meals", "Travel", None]), i) for i in range(200)]
    rng.shuffle(rows)
    got = {r.line: r.usual_category for r in ledger.category_deviations(
        spark.createDataFrame(rows, "client string, merchant string, category string, line bigint"), width=width).collect()}
    want, seen = {}, {}
    for client, merchant, category, line in sorted(rows, key=lambda r: r[3]):
        counts = seen.setdefault((client, key(merchant)), {})
        if category is not None:
            if counts and (usual := min(counts, key=lambda c: (-counts[c], c))) != category:
                want[line] = usual
            counts[category] = counts.get(category, 0) + 1
    assert got == want and len(want) > 50


def test_whitelist_never_clears_a_reading_question(spark):
    rows = spark.createDataFrame([("c", "Tesco", ["personal_spending", "foreign_currency"]), ("c", "Shell", ["personal_spending"])],
                                 "client string, merchant string, reasons array<string>")
    approved = spark.createDataFrame([("c", "Tesco")], "client string, merchant string")
    got = {r["merchant"]: (r["open_reasons"], r["needs_review"]) for r in ledger.cleared_reasons(rows, approved).collect()}
    assert got == {"Tesco": (["foreign_currency"], True), "Shell": (["personal_spending"], True)}


def test_archive_names(spark):
    rows = spark.createDataFrame([("c", i, "Shell Service", date(2026, 3, 14), Decimal("48.20"), p) for i, p in enumerate(
        ["in/a.JPG", "in/b.jpg", "in/c.pdf", "202603_March/2026-03-14_shell-service_48.20.jpg"])],
        "client string, seq bigint, merchant string, purchase_date date, gross_amount decimal(18,2), source_path string")
    taken = spark.createDataFrame([("c", "202603_March", "2026-03-14_shell-service_48.20", "jpg", n) for n in (3, 1)], "client string, folder string, stem string, ext string, n int")
    got = {r["seq"]: r["file_path"].split("/")[-1] for r in ledger.archive_names(rows, taken).collect()}
    assert got == {0: "2026-03-14_shell-service_48.20-2.jpg", 1: "2026-03-14_shell-service_48.20-4.jpg",
                   2: "2026-03-14_shell-service_48.20.pdf", 3: "2026-03-14_shell-service_48.20.jpg"}


@pytest.mark.parametrize("block", [0, 6, 1000])
def test_archive_names_at_once_and_in_blocks(spark, tmp_path, block):
    rng = random.Random(5)
    rows = [("c", i, m, date(2026, 3, 14), Decimal("1.00"), f"in/{i}.jpg") for i, m in enumerate(
        rng.choices(["Hot", "hot!", "Cafe", "Bar"], [20, 20, 3, 2], k=120))]
    taken = [("c", "202603_March", f"2026-03-14_{s}_1.00", "jpg", n) for s in ("hot", "cafe", "bar") for n in rng.choices(range(1, 60), k=30)]
    spark.createDataFrame(rows, "client string, seq bigint, merchant string, purchase_date date, gross_amount decimal(18,2), source_path string"
                          ).write.parquet(str(tmp_path / "incoming"))
    archived = spark.createDataFrame(taken, "client string, folder string, stem string, ext string, n int")
    want, used = {}, {(stem, n) for _, _, stem, _, n in taken}
    for _, seq, merchant, *_ in rows:
        stem = f"2026-03-14_{key(merchant)}_1.00"
        n = next(n for n in range(1, 1000) if (stem, n) not in used)
        used.add((stem, n))
        want[seq] = f"202603_March/{stem}{f'-{n}' if n > 1 else ''}.jpg"
    named = ledger.archive_names(spark.read.parquet(str(tmp_path / "incoming")), archived, block=block)
    assert {r["seq"]: r["file_path"] for r in named.collect()} == want


def test_archive_names_reads_and_names_its_rows_once(spark, tmp_path):
    spark.createDataFrame([("c", 1, "Shell", date(2026, 3, 14), Decimal("1.00"), "in/a.jpg")],
                          "client string, seq bigint, merchant string, purchase_date date, gross_amount decimal(18,2), source_path string"
                          ).write.parquet(str(tmp_path / "incoming"))
    taken = spark.createDataFrame([("c", "202603_March", "2026-03-14_shell_1.00", "jpg", 1)], "client string, folder string, stem string, ext string, n int")
    named = ledger.archive_names(spark.read.parquet(str(tmp_path / "incoming")), taken)
    plan = named._jdf.queryExecution().executedPlan().toString()
    # What numbers the rows reads written names, and the files and taken numbers meet in one shuffle.
    assert str(tmp_path / "incoming") not in plan and "regexp_extract" not in plan
    assert plan.count("Exchange ") == 1
    assert [r["file_path"] for r in named.collect()] == ["202603_March/2026-03-14_shell_1.00-2.jpg"]


def write(path, header, rows):
    path.write_text("\n".join([",".join(header), *rows]) + "\n")
    return str(path)


def test_ledger_csv(spark, tmp_path):
    good = write(tmp_path / "a.csv", LEDGER_COLUMNS, [
        'Shell,2026-03-14,GBP,48.20,8.03,40.17,A-1,Fuel,0.96,no,,a/b.jpg,2026-03-31T09:12:04',
        '"Nando\'s, Cardiff",2026-03-22,GBP,64.50,10.75,53.75,,Meals,0.61,yes,unclear,a/c.jpg,2026-03-31T09:12:14'])
    rows = {r["merchant"]: r for r in files.read_ledger(spark, good).collect()}
    assert rows["Nando's, Cardiff"]["needs_review"] and rows["Shell"]["gross_amount"] == Decimal("48.20")
    assert rows["Shell"]["processed_at"].isoformat() == "2026-03-31T09:12:04"
    swapped = LEDGER_COLUMNS[1:] + LEDGER_COLUMNS[:1]
    with pytest.raises(ValueError):
        files.read_ledger(spark, write(tmp_path / "b.csv", swapped, []))


def test_inventory(spark, tmp_path):
    inbox = tmp_path / "receipts"
    (inbox / "_processed-receipts" / "202603_March").mkdir(parents=True)
    for name in ("a.jpg", "b.PDF", ".DS_Store", "c.xyz", "_processed-receipts/202603_March/d.jpg"):
        (inbox / name).write_text("x")
    got = {r["name"]: (r["hidden"], r["open_as"]) for r in files.inventory(spark, str(inbox)).collect()}
    got.pop(".DS_Store", None)
    assert got == {"a.jpg": (False, "image"), "b.PDF": (False, "pdf"), "c.xyz": (False, "unrecognised format")}


def test_reference_lists(spark):
    lines = spark.createDataFrame([("# Heading",), ("| Category | What |",), ("|---|---|",), ("| `Fuel` | Petrol |",), ("- Canva",), ("",)], "value string")
    assert [r[0] for r in files.category_list(lines).collect()] == ["Fuel"]
    assert "Canva" in [r[0] for r in files.vendor_list(lines).collect()]


def test_audit(spark):
    # Both clients book r/a.jpg, and only c has it.
    books = spark.createDataFrame([("c", "r/a.jpg"), ("c", "r/b.jpg"), ("c", None), ("d", "r/x.jpg"), ("d", "r/a.jpg")], "client string, file_path string")
    archive = spark.createDataFrame([("c", "r/a.jpg", False), ("c", "r/z.jpg", False), ("c", "r/.hidden", False), ("c", "needs-review.md", True),
                                     ("c", "r/needs-review.md", False), ("d", "r/x.jpg", False)], "client string, path string, top_level boolean")
    got = {r["client"]: (r["rows"], r["missing"], r["orphans"], r["clean"]) for r in ledger.audit(books, archive).collect()}
    assert got == {"c": (3, 2, 2, False), "d": (2, 1, 0, False)}
    assert [(r["client"], r["file_path"]) for r in ledger.missing_files(books, archive).filter("file_path = 'r/a.jpg'").collect()] == [("d", "r/a.jpg")]


def test_summary_message(spark):
    rows = spark.createDataFrame([("c", "gbp", Decimal("1200.50"), True), ("c", "EUR", Decimal("7.40"), False), ("c", "AED", Decimal("3.00"), False),
                                  ("d", "GBP", Decimal("5.00"), False)], "client string, currency string, gross_amount decimal(18,2), needs_review boolean")
    got = {r["client"]: (r["flagged"], r["message"]) for r in ledger.run_summary(rows).collect()}
    assert got == {"c": (1, "3 receipts processed and logged — 3.00 AED, €7.40 and £1,200.50 total."),
                   "d": (0, "1 receipt processed and logged — £5.00 total.")}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("c", 1), ("c", 2)], "client string, line int")
    for run, part in (("r1", rows.filter("line = 1")), ("r2", rows.filter("line = 2")), ("r2", rows.filter("line = 2"))):
        exports.append_ledger(part, path, run)
    assert sorted((r["line"], r["run_id"]) for r in spark.read.parquet(path).collect()) == [(1, "r1"), (2, "r2")]
    # A client that drops out of a repeated run leaves no rows of that run.
    exports.append_ledger(spark.createDataFrame([("d", 9)], "client string, line int"), path, "r2")
    assert sorted((r["client"], r["line"]) for r in spark.read.parquet(path).collect()) == [("c", 1), ("d", 9)]


def test_whole_run(spark):
    raw = spark.createDataFrame([
        ("c", 1, "Shell", "A1", "2026-03-14", "48.20", "8.03", None, "0.96", False, "", "GBP", "Fuel", "in/1.jpg", False),
        ("c", 2, "Shell", "a1", "2026-03-15", "50.00", "8.00", None, "0.96", False, "", "GBP", "Fuel", "in/2.jpg", False),
        ("c", 3, "Cafe", "", "2026-03-15", "7.40", "0.49", None, "0.60", False, "blurred", "EUR", "Uncategorised", "in/3.png", False),
        ("c", 4, "Cafe", "", "yesterday", "7.40", "0.49", None, "0.90", False, "", "GBP", "Meals", "in/4.png", False)],
        "client string, seq bigint, merchant string, receipt_number string, purchase_date string, gross_amount string, tax_amount string, net_amount string, "
        "confidence string, needs_review boolean, review_notes string, currency string, category string, source_path string, force boolean")
    booked = spark.createDataFrame([], OLD + ", file_path string")
    run = ledger_run.build(raw, booked, spark.createDataFrame([], "client string, vendor string"),
                           spark.createDataFrame([("c", "202603_March/2026-03-14_shell_48.20.jpg")], "client string, path string"))
    assert [r["seq"] for r in run["rejected"].collect()] == [4]
    assert [r["seq"] for r in run["duplicates"].collect()] == [2]
    written = {r["seq"]: set(r["open_reasons"]) for r in run["written"].collect()}
    assert written == {1: set(), 3: {"foreign_currency", "uncategorised", "low_confidence"}}
    audit = run["audit"].first()
    assert (audit["rows"], audit["missing"], audit["orphans"]) == (2, 1, 0)
