"""Data-chain analytics on Spark: facts, property graphs, chains, contracts, reports."""

__version__ = "0.1.0"
