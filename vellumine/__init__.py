"""Document analytics on Spark: retrieval, grounding, ingestion state and corpus preparation as DataFrame transforms."""

__version__ = "0.1.0"
