"""Training-data operators: search, language, packing, near-duplicate, extraction, quality, mixing and archive jobs.

Nothing outside this subpackage imports it.
"""
