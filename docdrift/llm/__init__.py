"""Training-data operators: cleaning, deduplication, archives, tokens, packing."""
