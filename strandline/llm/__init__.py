"""Training-data operators: language, duplicates, overlap, privacy, archives, tokens, shards."""
