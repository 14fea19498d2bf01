"""Training-data operators: ten jobs over documents, pages and conversations.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own interface; `queries.py` registers the thin digests.
"""
