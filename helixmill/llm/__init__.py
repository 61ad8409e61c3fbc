"""Training-data operators: near-dedup, tokenisation, mixing, record files, quality, PII, fingerprints.

Nothing outside this subpackage imports it.
"""
