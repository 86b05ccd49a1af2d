"""Scalar functions: column expressions, and small numeric routines for drivers and Python stages."""
