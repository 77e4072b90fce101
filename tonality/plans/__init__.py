"""Composed plans: the pipeline, the registered queries and their SQL oracles."""
