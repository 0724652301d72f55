"""Training-data operators: classification, packing, tokenising, search, dedup, scoring, media, sharding."""
