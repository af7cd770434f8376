"""Operators of a training-data pipeline over whole text corpora.

Each module holds one operator with a general interface; ``queries`` holds the thin registered
queries that bind an operator to its table and contract. Nothing else in the package imports this.
"""
