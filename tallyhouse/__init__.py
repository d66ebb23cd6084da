"""Retail lakehouse analytics on PySpark: ingest, cleanse, model, report."""
