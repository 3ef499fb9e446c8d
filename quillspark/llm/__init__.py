"""Operators that prepare corpora for training language models.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
