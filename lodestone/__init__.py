"""A Spark-first analytics engine for code and text records."""
