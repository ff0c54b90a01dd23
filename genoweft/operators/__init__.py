"""Operators of the gene-program engine."""
