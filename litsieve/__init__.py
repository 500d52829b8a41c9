"""Article-record screening on Spark: extract, search, dedup, rank, expand."""
