"""Set-oriented building blocks: predicates, ingestion, resolution, merges, audits."""
