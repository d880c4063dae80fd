"""Operators for large-scale training-data pipelines.  Nothing else in skyfront imports this subpackage."""
