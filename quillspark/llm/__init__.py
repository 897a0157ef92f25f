"""Training-data operators: quality, dedup, licences, tokens, language, mixing, extraction and privacy."""
