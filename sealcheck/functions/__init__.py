"""Column functions: identity, JSON, text and digests."""
