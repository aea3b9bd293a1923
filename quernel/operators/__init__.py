"""Indexes over DataFrames and their statistics."""
