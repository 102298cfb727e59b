"""Readers of character data, cost matrices and graphs."""
