"""Distributed operators: folds, identity, history, graph."""
