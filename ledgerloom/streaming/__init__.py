"""Structured Streaming arrivals and windows."""
