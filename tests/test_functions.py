import math

from pyspark.sql import functions as F

from tidemark.functions import dates, display, nulls, text


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return row.asDict()


def test_absent_is_not_zero(spark):
    null = F.lit(None).cast("double")
    got = one(
        spark, div0=nulls.safe_div(F.lit(1), F.lit(0)), div00=nulls.safe_div(F.lit(0), F.lit(0)),
        divn=nulls.safe_div(null, F.lit(2)), add=nulls.null_add(null, F.lit(3.0)),
        addn=nulls.null_add(null, null), bad=nulls.to_number(F.lit("1,5")),
        micros=nulls.micros_to_currency(F.lit(135500000)))
    assert got == {"div0": None, "div00": None, "divn": None, "add": 3.0, "addn": None,
                   "bad": None, "micros": 135.5}


def test_rounding(spark):
    inf = F.lit(math.inf)
    got = one(spark, even=nulls.rnd(F.lit(2.5), 0), up=nulls.rnd(F.lit(3.5), 0),
              nan=nulls.rnd(F.lit(math.nan), 2), inf=nulls.rnd(inf, 2),
              ninf=nulls.rnd(-inf, 2), two=nulls.rnd(F.lit(1.005), 2), neg=nulls.rnd(F.lit(-0.2), 0))
    assert got == {"even": 2.0, "up": 4.0, "nan": None, "inf": None, "ninf": None, "two": 1.0,
                   "neg": 0.0}
    assert math.copysign(1, got["neg"]) == 1


def test_weighted_position(spark):
    df = spark.createDataFrame([(3.0, 40000), (90.0, 4), (None, 50), (5.0, 0), (7.0, None)],
                               "v double, w bigint")
    row = df.agg(nulls.weighted_mean(F.col("v"), F.col("w")).alias("m"),
                 nulls.weight_used(F.col("v"), F.col("w")).alias("w")).first()
    assert row["m"] < 3.1 and row["w"] == 40004
    empty = df.filter("v is null").agg(nulls.weighted_mean(F.col("v"), F.col("w")).alias("m"),
                                       nulls.weight_used(F.col("v"), F.col("w")).alias("w")).first()
    assert empty["m"] is None and empty["w"] == 0


def test_urls(spark):
    urls = ["https://x.com/a/b?q=1", "https://x.com", "https://x.com?z=2", "/only/path", "", None,
            "https://x.com/a#frag"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r[0] for r in df.orderBy("i").select(text.short_url(F.col("u"))).collect()]
    assert got == ["/a/b?q=1", "/", "/?z=2", "/only/path", "", "", "/a"]


def test_sites(spark):
    values = ["SC-Domain:Example.COM/", ' "HTTPS://Shop.Example.com/Blog" ', "example.com",
              "sc-domain:https://example.com/x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    s = df.orderBy("i").select(text.site_url(F.col("v")).alias("s"))
    rows = s.select("s", text.site_kind(F.col("s")).alias("k"), text.site_display(F.col("s")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [
        ("sc-domain:example.com", "domain", "example.com"),
        ("https://shop.example.com/Blog/", "url_prefix", "shop.example.com"),
        (None, None, None), ("sc-domain:example.com", "domain", "example.com")]
    stem = spark.range(1).select(text.site_stem(F.lit("https://www.example.com/"))).first()[0]
    assert stem == "www-example-com"


def test_merchants(spark):
    cases = {"TESCO STORES 4471 CARDIFF": "TESCO STORES", "SQ *BLUE BOTTLE": "BLUE BOTTLE",
             "Acme Widgets, Ltd.": "Acme Widgets", "Stripe *": "Stripe", "Müller GmbH": "Müller"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for row in df.select("want", text.clean_merchant(F.col("raw")).alias("got")).collect():
        assert row["got"] == row["want"]
    got = one(spark, slug=text.slug(F.lit("Nando's, Cardiff Bay")), none=text.slug(F.lit("--")),
              long=text.slug(F.lit("a" * 39 + " b" * 5)), key=text.merchant_key(F.lit("Nando's 2")),
              money=text.money(F.lit("£1,234.56")), neg=text.money(F.lit("-12.5")), bad=text.money(F.lit("n/a")))
    assert got["slug"] == "nando-s-cardiff-bay" and got["none"] == "unknown"
    assert got["long"] == "a" * 39 and got["key"] == "nandos2"
    assert str(got["money"]) == "1234.56" and str(got["neg"]) == "-12.50" and got["bad"] is None


def test_receipt_dates(spark):
    cases = [("2026-04-03", "GBP", "2026-04-03", None, False), ("17/04/26", "USD", "2026-04-17", None, False),
             ("04/17/2026", "GBP", "2026-04-17", None, False), ("03/04/2026", "GBP", "2026-04-03", None, False),
             ("03/04/2026", "USD", "2026-03-04", None, False), ("4 Mar 2026", "CAD", "2026-03-04", None, False),
             ("03/04/2026", "CAD", "2026-04-03", "2026-03-04", True), ("05/05/2026", "CAD", "2026-05-05", None, False),
             ("soon", "GBP", None, None, True)]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, t string, c string")
    rows = df.orderBy("i").select(dates.resolve_receipt_date(F.col("t"), F.col("c")).alias("r")).select("r.*").collect()
    for row, want in zip(rows, cases):
        assert (str(row["date"]) if row["date"] else None, str(row["alternative"]) if row["alternative"] else None,
                row["needs_review"]) == want[2:], want


def test_strict_and_loose_dates(spark):
    got = one(spark, ok=dates.iso_date(F.lit("2026-03-14")), bad=dates.iso_date(F.lit("2026-3-14")),
              none=dates.iso_date(F.lit("2026-02-30")), compact=dates.compact_date(F.lit("20240229")),
              text=dates.compact_date(F.lit("(other)")), group=dates.day_group(F.lit(None).cast("date")))
    assert str(got["ok"]) == "2026-03-14" and got["bad"] is None and got["none"] is None
    assert got["compact"] == "2024-02-29" and got["text"] == "(other)" and got["group"] == "weekday"


def test_display(spark):
    expressions = {
        "'USD'|1234.5": display.money("1234.5D", "'USD'"), "col": display.money("12.0D", "c"),
        "unknown": display.money("12.0D", "'XTS'"), "null": display.money("CAST(NULL AS DOUBLE)", "'USD'"),
        "dec": display.value_text("490.0D", "decimal"), "dec2": display.value_text("3.456D", "decimal"),
        "dec1": display.value_text("34.56D", "decimal"), "dur": display.duration("104.0D"),
        "dur2": display.duration("3725.0D"), "pct": display.percent_text("CAST(NULL AS DOUBLE)", "'new'"),
        "delta": display.delta_text("-12.25D", "rate"), "gain": display.delta_text("5.0D", "currency", "'GBP'"),
        "k": display.compact_number("48210.0D"), "m": display.compact_number("2000000.0D"),
        "cell": display.csv_cell("1.50D"), "whole": display.csv_cell("2.0D"), "empty": display.csv_cell("CAST(NULL AS DOUBLE)")}
    row = spark.range(1).selectExpr("'EUR' AS c").selectExpr(
        *[f"{sql} AS `{n}`" for n, sql in expressions.items()]).first().asDict()
    assert row == {"'USD'|1234.5": "$1,234.50", "col": "€12.00", "unknown": "12.00 XTS", "null": "not available",
                   "dec": "490", "dec2": "3.46", "dec1": "34.6", "dur": "1:44", "dur2": "1:02:05", "pct": "n/a (from zero)",
                   "delta": "-12.25 pp", "gain": "+£5.00", "k": "48.2k", "m": "2M",
                   "cell": "1.5000", "whole": "2", "empty": ""}


def test_brand_terms(spark):
    df = spark.createDataFrame([("Acme shoes", ["ACME", " "]), ("shoes", ["acme"]), ("shoes", [])], "q string, t array<string>")
    got = [r[0] for r in df.select(text.matches_any_term(F.col("q"), F.col("t"))).collect()]
    assert got == [True, False, None]


def test_styles(spark):
    null = "CAST(NULL AS DOUBLE)"
    row = spark.range(1).selectExpr(*[f"{sql} AS c{i}" for i, sql in enumerate([
        display.value_text("54.25D", "rate", style=display.WEB_STYLE), display.value_text("12.0D", "decimal", style=display.WEB_STYLE),
        display.value_text("12.345D", "decimal", style=display.SEARCH_STYLE), display.delta_text("-65.0D", "duration", style=display.WEB_STYLE),
        display.percent_text(null, "'new'", display.WEB_STYLE), display.value_text("9.87D", "position", style=display.SEARCH_STYLE)])]).first()
    assert list(row)[:2] == ["54.2%", "12"] and row["c3"] == "-1:05" and row["c4"] == "new (was zero)" and row["c5"] == "9.9"
