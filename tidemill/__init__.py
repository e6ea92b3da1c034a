"""Content-intelligence pipelines as PySpark DataFrame jobs."""
