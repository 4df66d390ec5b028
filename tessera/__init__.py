"""Tessera: exact embedding retrieval, its evaluation and query adaptation, as Spark DataFrames."""
