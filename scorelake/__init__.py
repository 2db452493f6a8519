"""Prepare tables, train and score binary classifiers, and compare them, as Spark jobs."""
