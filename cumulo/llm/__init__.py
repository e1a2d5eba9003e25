"""Operators of a training-data pipeline over the corpus tables, and the queries that apply them."""
