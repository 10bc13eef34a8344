"""Training-data operators: filtering, deduplication, tokenising, packing and sharding of large text corpora."""
