"""Whole jobs (indexing, deduplication, triage) and the queries bound to the benchmark tables."""
