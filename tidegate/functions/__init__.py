"""Column expressions: ranks, risk measures, digests."""
