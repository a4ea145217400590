"""Operators for large-scale training-data work: dedup, filtering, mixing, sharding, WARC, HTML, tokens."""
