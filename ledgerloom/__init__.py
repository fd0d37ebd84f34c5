"""Reconciliation analytics as Spark jobs."""
