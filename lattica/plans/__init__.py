"""Registered query suite: what the driver and the benchmark run."""
