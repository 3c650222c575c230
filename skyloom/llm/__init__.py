"""Operators for building language-model training corpora.

The subpackage stands alone: nothing else in the library imports it, and it imports nothing else of the library.
"""
