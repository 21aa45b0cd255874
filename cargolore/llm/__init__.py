"""Operators for preparing large text corpora, each a Spark job of its own.

Nothing else in :mod:`cargolore` imports this subpackage.  ``registry`` lists
the queries and the SQL they are compared with.
"""
