"""Operators of a training-data pipeline over text corpora.

Nothing else in the package imports this subpackage; it may import the general
helpers (session, sources).  Each module holds one operator; ``queries``
registers one query per operator.
"""
