"""Functions of the gene-program engine."""
