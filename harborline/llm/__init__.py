"""Operators of a training-data pipeline: cleaning, near copies, mixing, tokens, packing, archives, vectors."""
