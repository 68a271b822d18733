"""A Spark-first analytics engine for object-motion data."""
