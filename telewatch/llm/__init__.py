"""Operators for training-data preparation: one module per operator.

Nothing outside this package imports it; ``catalog`` holds the registered
queries and their SQL twins.
"""
