"""Catalogue audit, record linkage and reporting as Spark jobs."""
