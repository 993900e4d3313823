"""Training-data operators: cleaning, deduplication, filtering, mixing and packing of text corpora."""
