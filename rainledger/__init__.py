"""Retail order lines joined with daily city weather, as PySpark DataFrame functions."""
