"""Parsimony kernels, graph, network, distance, clustering and search operators."""
