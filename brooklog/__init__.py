"""brooklog: log search and analysis as plain PySpark DataFrame jobs."""
