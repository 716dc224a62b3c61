"""Retention, in-doubt repair and training-data operators expressed as Spark jobs."""
