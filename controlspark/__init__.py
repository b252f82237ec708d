"""Ingestion, validation, correction, mapping and export of control catalogs, on Spark."""
