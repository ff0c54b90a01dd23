"""Plans of the gene-program engine."""
