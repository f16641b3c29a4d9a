"""Readers and writers: payload files, CSV files, the feature table and snapshots."""
