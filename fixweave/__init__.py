"""Vulnerability records, fix commits and patched functions as Spark tables."""
