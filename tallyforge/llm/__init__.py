"""Operators for preparing training text: one module each, DataFrame in and DataFrame out."""
