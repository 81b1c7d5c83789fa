"""Spatial-expression analytics as Spark DataFrame operators."""
