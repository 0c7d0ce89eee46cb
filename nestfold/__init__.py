"""Nested-resampling regression benchmarks as Spark jobs."""
