"""Column expressions: numbers, addresses, keys and texts of ledger data."""
