"""Spark jobs for large collections of case-file documents."""
