"""Whole plans made of operators."""
