"""Operators of a training-data pipeline over documents, pages, vectors and conversations.

Nothing else in the library imports this subpackage; `registry.all_queries()` lists its queries.
"""
