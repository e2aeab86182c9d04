"""Set-at-a-time analytics over bilingual text, written for Spark."""
