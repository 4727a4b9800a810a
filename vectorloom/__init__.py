"""vectorloom: analytics over tables of embeddings, written for Spark's DataFrame engine."""

__version__ = "0.1.0"
