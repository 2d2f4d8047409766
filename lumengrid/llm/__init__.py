"""Training-data operators: search, packing, secrets, near-duplicates, quality, mixing, chat, languages."""
