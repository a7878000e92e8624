"""Relational and graph operators on any tables."""
