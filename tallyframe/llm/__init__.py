"""Operators of a training-data pipeline.

Nothing else in the library imports this package; it imports only general
helpers (session, storage).  Queries are in ``queries.py``, their SQL twins
in ``sql.py``.
"""
