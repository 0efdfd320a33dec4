"""Spatial operators on streams."""
