"""Evaluation analytics on Spark: scoring, ranking, agreement and robustness of generated reports as DataFrame plans."""
