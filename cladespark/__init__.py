"""Phylogenetic parsimony analytics on Spark."""
