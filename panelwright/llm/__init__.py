"""Training-data operators: corpus filters, near-duplicate search, extraction and mixing.

Nothing outside this package imports it; deleting the folder leaves the factor library intact.
"""
