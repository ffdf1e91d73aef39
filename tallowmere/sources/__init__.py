"""Readers and writers: delimited, JSON lines, Parquet, nested archives, manifests, JDBC."""
