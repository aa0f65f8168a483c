"""Personal-finance ledger analytics as Spark DataFrame jobs."""
