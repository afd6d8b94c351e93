"""Spark-first analytics for a retail catalog and the text and social data around it."""
