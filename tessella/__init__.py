"""tessella: document-evidence analytics and corpus preparation expressed as Spark plans."""

__version__ = "0.1.0"
