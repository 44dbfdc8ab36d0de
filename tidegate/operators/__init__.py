"""Relational operators on panels, folds, ledgers and return tracks."""
