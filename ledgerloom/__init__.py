"""Spark jobs for brokerage ledgers of many accounts."""
