"""Keyed folds: one definition for bounded and for streaming data."""
