"""Audit-ledger analytics on Spark."""
