"""Code-graph and semantic-retrieval queries expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
