"""Operators for building training data: each module is one operator over DataFrames."""
