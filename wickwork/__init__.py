"""Candle features, labels and model evaluation as Spark DataFrame transforms."""
