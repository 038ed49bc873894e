"""Whole factorizations, composed of operators."""
