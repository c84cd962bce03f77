"""Corpus operators for training-data pipelines.

Nothing else in the package imports this subpackage; it can be deleted without
touching the annotation operators.
"""
