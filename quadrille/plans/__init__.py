"""Predicates, intervals and configuration."""
