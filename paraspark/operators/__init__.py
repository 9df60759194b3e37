"""DataFrame-to-DataFrame steps of the quantification."""
