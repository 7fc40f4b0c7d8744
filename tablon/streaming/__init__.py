"""Runs as micro-batches."""
