"""Stores and the catalogue of registered queries."""
