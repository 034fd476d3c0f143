"""Evidence analytics on Spark DataFrames: retrieval, graphs, reranking, evaluation."""

__version__ = "0.1.0"
