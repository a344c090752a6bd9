"""Operators for training-data pipelines over a ``documents`` / ``pages`` corpus.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; ``queries`` has the thin ``opN_<name>``
queries (and their SQL, where SQL can express them) on top.
"""
