"""Operators for preparing training text: deduplication, tokens, language, personal data, quality, toxicity, packing, media."""
