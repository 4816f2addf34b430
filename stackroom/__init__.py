"""Stackroom: document indexing, near-duplicate detection and hybrid search as Spark jobs."""

__version__ = "0.1.0"
