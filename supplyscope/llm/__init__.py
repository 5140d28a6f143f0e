"""Operators for preparing training corpora (documents, pages, conversations, embeddings).

Nothing else in the library imports this subpackage.  Each module is one operator with its own
interface; ``queries`` holds the thin ``opN_*`` queries over the synthetic tables.
"""
