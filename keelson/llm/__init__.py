"""Operators of a training-data pipeline: one module each, and nothing else in the library imports them."""
