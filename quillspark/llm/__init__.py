"""Operators that prepare text for the training of language models.

Nothing else in the library imports this subpackage.
"""
