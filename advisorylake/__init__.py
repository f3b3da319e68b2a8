"""Early-warning analytics over vulnerability mentions, as Spark DataFrame jobs."""
