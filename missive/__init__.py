"""Message-archive analytics on Spark: search, ingest, parsing and audit as DataFrame jobs."""
