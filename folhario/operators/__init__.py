"""Operators of the core: DataFrame in, DataFrame out."""
