"""Operators of a training-data pipeline over a table of documents.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it can be imported.
"""
