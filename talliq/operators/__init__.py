"""Folds, views and maintenance of ledger tables."""
