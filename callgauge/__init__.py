"""Spark-first analytics over logs of language-model calls."""
