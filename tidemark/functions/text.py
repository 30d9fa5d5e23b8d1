"""Labels, identifiers, URLs, merchants and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import DIRECTLY_READABLE, LEGAL_SUFFIXES, NEEDS_CONVERSION


def truncate(text: Column, width: int = 60) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.when(F.length(body) <= width, body).otherwise(
        F.concat(F.substring(body, 1, width - 1), F.lit("…"))
    )


def short_url(url: Column) -> Column:
    """Path and query of a URL; an empty path is '/', a value that is no URL stays as it is."""
    no_fragment = F.regexp_replace(url, "#.*$", "")
    rest = F.regexp_replace(no_fragment, "^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    shown = F.concat(
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(url.isNull() | (url == ""), "").otherwise(shown)


def compound_key(*parts: Column) -> Column:
    return F.concat_ws(" / ", *parts)


def slug(text: Column, limit: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(trimmed, 1, limit), "-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "unknown").otherwise(cut)


def site_stem(site_url: Column) -> Column:
    """A file-name stem for a search property."""
    named = F.replace(F.coalesce(site_url, F.lit("unknown")), F.lit("sc-domain:"), F.lit("domain-"))
    bare = F.regexp_replace(F.regexp_replace(named, "https?://", ""), "/+$", "")
    return F.regexp_replace(bare, "[^A-Za-z0-9-]", "-")


def merchant_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def money(text: Column) -> Column:
    """'£1,234.56' to decimal(18,2), half to even; anything without a number is null."""
    stripped = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.bround(stripped.try_cast("decimal(38,18)"), 2).try_cast("decimal(18,2)")


def currency_code(text: Column) -> Column:
    code = F.upper(F.trim(text))
    return F.when(F.coalesce(code, F.lit("")) == "", "???").otherwise(code)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def open_as(path: Column) -> Column:
    """How a receipt file opens. Never whether it is processed."""
    ext = extension(path)
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin(DIRECTLY_READABLE), "image")
        .when(ext.isin(NEEDS_CONVERSION), "needs conversion")
        .otherwise("unrecognised format")
    )


def archive_folder(purchase_date: Column) -> Column:
    return F.date_format(purchase_date, "yyyyMM_MMMM")


def archive_stem(purchase_date: Column, merchant: Column, gross: Column) -> Column:
    return F.concat_ws(
        "_",
        F.date_format(purchase_date, "yyyy-MM-dd"),
        slug(merchant),
        gross.cast("decimal(18,2)").cast("string"),
    )


def clean_merchant(text: Column) -> Column:
    """Trading name: text after a processor's '*', no legal suffix, no branch number onwards."""
    name = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[^*]*\*\s*", ""))
    name = F.when(name == "", F.trim(F.replace(text, F.lit("*"), F.lit("")))).otherwise(name)
    name = F.regexp_replace(name, r"\s+#?[0-9]{3,}.*$", "")
    return F.trim(
        F.regexp_replace(name, r"(?i)[\s,]+(" + "|".join(LEGAL_SUFFIXES) + r")\.?\s*$", "")
    )


def ads_account_id(text: Column) -> Column:
    """Ten digits, dashes and other punctuation ignored; anything else is null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 10, digits)


def web_property_id(text: Column) -> Column:
    """A numeric property id of 6 to 15 digits, or null for the other kinds of id."""
    raw = F.regexp_replace(F.trim(text), "(?i)^properties/", "")
    digits = F.regexp_replace(raw, "[^0-9]", "")
    wrong_kind = raw.rlike(r"(?i)^(G-[A-Z0-9]+|UA-[0-9]+-[0-9]+|GTM-[A-Z0-9]+)$")
    return F.when(~wrong_kind & F.length(digits).between(6, 15), digits)


def web_property_reject(text: Column) -> Column:
    """Why `web_property_id` is null; null itself when the id is good."""
    raw = F.regexp_replace(F.trim(text), "(?i)^properties/", "")
    digits = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    return (
        F.when(raw.rlike(r"(?i)^G-[A-Z0-9]+$"), "measurement id")
        .when(raw.rlike(r"(?i)^UA-[0-9]+-[0-9]+$"), "retired property kind")
        .when(raw.rlike(r"(?i)^GTM-[A-Z0-9]+$"), "tag container id")
        .when(digits == 0, "no digits")
        .when(~digits.between(6, 15), "wrong length")
    )


def site_url(text: Column) -> Column:
    """A search property identifier; a bare host is ambiguous and becomes null."""
    raw = F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", "")
    is_domain = F.lower(raw).startswith("sc-domain:")
    domain = F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(raw.substr(F.lit(11), F.length(raw)))), "/+$", ""),
        "^https?://([^/?#]*).*$", "$1",
    )
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    slashed = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return (
        F.when(is_domain, F.concat(F.lit("sc-domain:"), domain))
        .when(scheme != "", F.concat(scheme, F.lit("://"), host, slashed))
    )


def site_kind(site: Column) -> Column:
    return F.when(site.isNotNull(), F.when(F.lower(F.trim(site)).startswith("sc-domain:"), "domain")
                  .otherwise("url_prefix"))


def site_display(site: Column) -> Column:
    host = F.regexp_extract(site, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(
        F.lower(site).startswith("sc-domain:"), F.regexp_replace(site, "^[^:]*:", "")
    ).otherwise(F.when(host == "", site).otherwise(host))


def matches_any_term(text: Column, terms: Column) -> Column:
    """True when a lower-cased text holds any configured term; null without terms."""
    usable = F.filter(terms, lambda t: F.trim(t) != "")
    return F.when(
        F.size(terms) > 0, F.exists(usable, lambda t: F.contains(F.lower(text), F.lower(t)))
    )
