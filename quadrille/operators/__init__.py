"""Relational operators over spatial keys."""
