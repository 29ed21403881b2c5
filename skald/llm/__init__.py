"""Operators for preparing language-model training text at scale.

Nothing outside this package imports it.  Each ``opN`` module holds one
operator with its own general interface; ``queries`` binds them to the tables.
"""
