"""Training-data operators: fingerprints, mixing, quality, media, dedup, PII, language and tokens.

Nothing outside this subpackage imports it.
"""
