"""Training-data operators: near-duplicates, language, quality, PII, tokens, packing."""
