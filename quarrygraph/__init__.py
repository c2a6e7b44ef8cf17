"""Versioned property-graph and corpus analytics on PySpark."""
