"""Training-data operators: scoring, deduplication, filtering, tokenising and packing of text corpora."""
