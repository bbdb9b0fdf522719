"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries`` in here
registers its ten operators and the corpus pipeline.
"""
