"""A Spark-first analytics engine for security findings."""
