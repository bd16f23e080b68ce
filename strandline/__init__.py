"""Strandline: genomic and tabular analytics expressed as PySpark plans."""

__version__ = "0.1.0"
