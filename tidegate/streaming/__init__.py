"""The forward ledger as a stream."""
