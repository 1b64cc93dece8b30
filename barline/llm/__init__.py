"""Training-data operators: tokenising, near-duplicates, search, filters, packing and token files."""
