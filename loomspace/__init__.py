"""Spatial topology analytics on Spark."""
