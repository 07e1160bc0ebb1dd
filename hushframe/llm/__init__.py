"""Training-data operators: packing, secrets, quality, near-duplicates, mixing, sharding, language, lines, urls, search.

Nothing else in the library imports this package.
"""
