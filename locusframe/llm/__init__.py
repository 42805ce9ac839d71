"""Training-data operators: deduplication, tokens, quality, packing, privacy, mixing, fingerprints, secrets, toxicity, URLs.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the thin queries over the driver tables are in ``queries``.
"""
