"""Training-data operators: dedup, scoring, filtering, packing, web archives.

Nothing else in ``rasterloom`` imports this subpackage.
"""
