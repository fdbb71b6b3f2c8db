"""Distributed building blocks: counts, ranks, quantiles, profiling, repair, stages."""
