"""Operators of a training-data pipeline: tokens, near duplicates, shards, mixes, quality, extraction."""
