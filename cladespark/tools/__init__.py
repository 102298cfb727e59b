"""Generators and small utilities for data sets, sequences, cost matrices and trees."""
