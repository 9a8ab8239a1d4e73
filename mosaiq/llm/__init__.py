"""Operators for preparing text and vector corpora; see the module docstrings."""
