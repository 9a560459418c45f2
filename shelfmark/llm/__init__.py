"""Training-data operators: mixing, deduplication, filtering, classification, tokenization, media, chat and privacy."""
