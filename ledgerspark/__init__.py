"""Multi-chain ledger data on Spark: decoding, validation, reorganisations, ledgers and reports."""
