"""Queries over the test tables and the pipeline of one run."""
