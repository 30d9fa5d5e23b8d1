"""One run of the expense ledger for every client: check, file, archive, report, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import ledger
from ..session import stage


def build(
    raw: DataFrame, booked: DataFrame, whitelist: DataFrame, files: DataFrame,
    home_currency: str = "GBP",
) -> dict[str, DataFrame]:
    """Parts of the run by name.

    `raw` are text receipts with client, seq, source_path and force; `booked` is the ledger so far
    with a `line`; `files` is the archive inventory with client and path.
    """
    checked = stage(ledger.check_rows(raw), "ledger-checked")
    accepted = checked.filter("reject_reason IS NULL")
    filed = stage(ledger.file_batch(accepted, booked), "ledger-filed")
    written = filed.filter("state = 'written'")
    named = ledger.archive_names(written)
    approved = ledger.whitelist_matches(named, whitelist)
    reviewed = stage(ledger.cleared_reasons(
        ledger.review_reasons(named, home_currency), approved), "ledger-reviewed")
    together = booked.select("client", "file_path").unionByName(
        reviewed.select("client", "file_path"))
    return {
        "rejected": checked.filter("reject_reason IS NOT NULL"),
        "duplicates": filed.filter("state = 'duplicate'"),
        "written": reviewed,
        "review_list": ledger.review_list(reviewed),
        "summary": ledger.run_summary(reviewed),
        "audit": ledger.audit(together, files),
    }
