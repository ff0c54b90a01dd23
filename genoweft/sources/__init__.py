"""Sources of the gene-program engine."""
