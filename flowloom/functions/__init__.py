"""Column expressions: canonical spellings, portable hashes, scalar formulas."""
