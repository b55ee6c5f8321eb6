"""Corpus analytics on Spark: DataFrame-in, DataFrame-out operators for news and document collections."""
