"""DataFrame operators: profiling, sampling, metrics, curves, comparison and prompt scoring."""
