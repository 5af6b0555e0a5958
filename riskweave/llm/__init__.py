"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.
"""
