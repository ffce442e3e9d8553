"""Training-corpus preparation as Spark jobs: documents and conversations in, token blocks out."""

__version__ = "0.1.0"
