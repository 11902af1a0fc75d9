"""Operators for training-data pipelines, one module per operator, and the queries that apply them."""
