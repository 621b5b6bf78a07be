"""Operators of a large-scale training-data pipeline, each a function over DataFrames."""
