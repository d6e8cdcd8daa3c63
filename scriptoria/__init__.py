"""Literature analytics on PySpark: retrieval, curation, ledgers and training-data operators."""
