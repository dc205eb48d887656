"""Operators of a training-data pipeline: toxicity, search, tokenising, licences, dedup, packing, quality."""
