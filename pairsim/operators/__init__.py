"""Operators: DataFrame in, DataFrame out; chain them with ``df.transform``."""
