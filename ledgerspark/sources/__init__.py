"""Readers of raw ledger data: RPC dumps, block ranges, messages, relational tables."""
