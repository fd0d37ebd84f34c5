"""Adapter views over the driver's tables, and the reports."""
