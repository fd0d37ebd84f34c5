"""Readers of register CSVs, statement and inbox JSON, gateway XML; idempotent writers."""
