"""Composed pipelines: preparation, training, baseline and experiment tables."""
