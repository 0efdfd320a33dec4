"""Geometry as Column expressions."""
