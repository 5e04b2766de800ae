"""Operators on long tracking tables."""
