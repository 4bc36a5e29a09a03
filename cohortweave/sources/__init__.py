"""Readers and writers: CSV, JSON, Parquet and file trees."""
