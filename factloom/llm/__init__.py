"""Training-data operators: cleaning, deduplication, scanning, mixing, tokenizing, extraction."""
