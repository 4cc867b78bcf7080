"""Spark-first analytics over messy product feeds; see README.md."""
