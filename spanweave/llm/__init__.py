"""Training-data operators: filtering, deduplication, search, packing and mixing of document corpora.

Nothing outside this folder imports it.
"""
