"""Snapshot comparison of tree-structured records, and training-data preparation, on Spark."""
