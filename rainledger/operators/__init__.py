"""Joins, imputation and data-quality steps between the base tables and the reports."""
