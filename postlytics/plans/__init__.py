"""Pipelines (M1-M9) and the catalogue of registered queries."""
