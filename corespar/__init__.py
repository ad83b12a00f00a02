"""corespar: document-retrieval and data-preparation analytics as PySpark jobs."""

__all__ = ["session", "tables"]
