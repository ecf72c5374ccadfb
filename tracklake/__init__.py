"""Track and embedding analytics, written as PySpark DataFrame jobs."""
