"""Stock-health analytics over a daily ledger, written as Spark DataFrame jobs."""
