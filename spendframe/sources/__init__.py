"""Delimited ledgers and file listings."""
