"""Operators on matrices that are tables: products, reductions, point selection, solvers, Fourier transforms."""
