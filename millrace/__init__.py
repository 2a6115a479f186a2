"""millrace: corpus analytics and training-data preparation expressed as Spark plans."""

__version__ = "0.1.0"
