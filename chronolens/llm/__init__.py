"""Training-data operators: scoring, filtering, deduplication, mixing and token output.

Nothing else in the library imports this subpackage; its queries are in :mod:`.queries`.
"""
