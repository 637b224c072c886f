"""Tidemark: change-data lakehouse operators and jobs for retail orders, written for PySpark."""

__version__ = "0.1.0"
