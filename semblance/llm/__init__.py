"""Operators for preparing language-model training data.

Self-contained: it imports nothing from the rest of the library, and nothing
there imports it.
"""
