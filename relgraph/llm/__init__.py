"""Training-data operators: licence scans, URL filters, quality, dedup, tokens, mixing, extraction.

Nothing else in the library imports this subpackage.
"""
