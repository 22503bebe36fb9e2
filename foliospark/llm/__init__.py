"""Training-data pipeline operators: tokenization, deduplication, quality, packing, sharding, archives, search, PII.

Nothing outside this subpackage imports it.
"""
