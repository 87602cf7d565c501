"""Document-to-ledger processing for large corpora, on Spark."""
