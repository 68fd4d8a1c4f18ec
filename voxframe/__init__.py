"""A Spark-first engine for ordered intervals, timed text and vectors."""
