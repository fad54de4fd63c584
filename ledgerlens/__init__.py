"""Temporal memory ledger analytics, expressed as Spark DataFrame transformations."""
