"""Part of loomline, a Spark engine for time-series tables."""
