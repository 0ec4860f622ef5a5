"""Training-data operators: quality, tokens, deduplication, language, media, secrets and mixing."""
