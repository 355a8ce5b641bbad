"""Incremental SQL analytics on Spark: weighted collections, views that follow their inputs, and batch queries."""
