"""Training-data operators: quality, tokens, duplicates, secrets, archives, packing, scoring."""
