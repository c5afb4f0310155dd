"""Ranking analytics on Spark: typed observations, current state, statistics and refresh planning."""
