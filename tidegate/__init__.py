"""Leakage-safe validation of panel time-series models and strategies on Spark."""
