"""Operators for training-data preparation and the queries that apply them to the shared tables."""
