"""Text-page analytics as Spark DataFrame operations."""
