"""Covenant analytics over ledgers and documents, as Spark DataFrame programs."""
