"""Column functions: text normalisation, numbers, digests."""
