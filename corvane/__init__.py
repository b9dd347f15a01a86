"""Analytics on scored, array-valued recordings and on text corpora, as Spark DataFrame operations."""
