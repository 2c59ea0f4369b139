"""Spark jobs that find personal information and credentials in large document collections."""
