"""Readers and writers: CSV, JDBC, source fallback, and the driver's test tables."""
