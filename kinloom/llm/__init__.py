"""Operators for training-data pipelines; nothing else in kinloom imports this subpackage."""
