"""Spark-native engine for auditing labelled image collections and evaluating models on them."""

__version__ = "0.1.0"
