"""Training-data operators: deduplication, quality, tokens, packing, private data."""
