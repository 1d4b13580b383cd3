"""Time-series compression and analytics on Spark."""
