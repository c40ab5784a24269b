"""Alidade: a Spark-first engine for auditable factor research on panels."""

__version__ = "0.1.0"
