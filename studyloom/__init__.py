"""Clinical-study operations analytics as Spark DataFrame jobs."""
