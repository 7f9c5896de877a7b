"""Health checks for the files of a data lake, written as PySpark DataFrame jobs."""
