"""Class-balanced binary classifiers on Spark MLlib: build, train, tune, combine, inspect, store."""
