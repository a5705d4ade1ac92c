"""Text/audio alignment analytics as Spark DataFrame jobs."""
