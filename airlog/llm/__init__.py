"""Operators for training-data corpora: near duplicates, mixing, sharding, tokens, language, search, chat."""
