"""Streaming: none.

The annotation stages read whole tables; their model has no streams, windows in event
time or late data. Column functions of annoweave.functions and
annoweave.operators.validation.validated work unchanged on streaming DataFrames.
"""
