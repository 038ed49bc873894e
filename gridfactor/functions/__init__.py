"""Scalar functions: complex numbers as two columns, index arithmetic, guarded division."""
