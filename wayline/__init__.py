"""Wayline: traffic-trajectory analytics as Spark DataFrame and Structured Streaming operators."""
