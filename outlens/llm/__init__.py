"""Training-data operators (dedup, filters, tokens, shards, packing).

Nothing else in the library imports this subpackage.
"""
