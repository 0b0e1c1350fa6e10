"""vaultspark: a PySpark engine for document knowledge bases and training-data corpora."""

__version__ = "0.1.0"
