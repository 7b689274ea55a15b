"""Bulk résumé analytics on Spark: archives to tables, and queries over those tables."""

__version__ = "0.1.0"
