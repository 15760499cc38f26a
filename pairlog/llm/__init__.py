"""Operators for training-data pipelines: one module each, with their named queries in ``queries``."""
