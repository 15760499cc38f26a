"""Readers for experiment files, and canonical views over the star-schema tables."""
