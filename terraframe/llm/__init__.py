"""Training-data operators over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each operator module holds
one operator and, at its end, the thin ``opN_*`` query over a whole table.
"""
