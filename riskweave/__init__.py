"""Text-risk analytics and corpus preparation expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
