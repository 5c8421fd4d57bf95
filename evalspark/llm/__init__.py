"""Operators for preparing training text: cleaning, near duplicates, tokens, masking, sharding."""
