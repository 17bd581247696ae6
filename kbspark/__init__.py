"""Spark jobs over versioned document collections."""
