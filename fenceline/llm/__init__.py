"""Operators of a training-data pipeline: quality, privacy, licences, secrets, copies, tokens, search, mixing, packing."""
