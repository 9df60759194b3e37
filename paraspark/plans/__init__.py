"""Composed plans: the assay pipeline, the registered queries, their SQL."""
