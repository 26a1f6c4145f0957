"""Readers and writers: CSV, Parquet and the model table."""
