"""Completeness, integrity and hierarchy checks over data backups, as Spark DataFrame operators."""
