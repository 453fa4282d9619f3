"""Wayloom: road-network routing and place search as Spark DataFrame pipelines."""
