"""Period-over-period reporting and expense ledgers for every account in one Spark job."""
