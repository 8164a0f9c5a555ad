"""plumbline: set-at-a-time evaluation and diagnosis of retrieval-augmented question answering on Spark."""

__version__ = "0.1.0"
