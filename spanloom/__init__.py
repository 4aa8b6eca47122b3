"""Timeline analytics on Spark: interval tables, agreement metrics, sampling and ingestion."""
