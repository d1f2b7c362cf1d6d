"""Training-data operators: dedup, PII, token files, quality, decontamination, URL and WARC tools.

Nothing else in the library imports this subpackage; it can be deleted without breaking the rest.
"""
