"""Filesystem-inventory analytics as Spark jobs."""
