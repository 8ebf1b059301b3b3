"""lagmill: lag-correlation and time-series analytics as PySpark DataFrame jobs."""
