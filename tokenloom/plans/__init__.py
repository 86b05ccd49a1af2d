"""Compositions of operators: queries by name with their SQL, and staged experiments."""
