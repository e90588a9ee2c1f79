"""Federated ranking, fusion and evaluation as Spark DataFrame plans."""
