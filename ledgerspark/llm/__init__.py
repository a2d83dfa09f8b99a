"""Training-data operators: de-duplication, classification, mixing, sharding and packing of text.

Nothing outside this package imports it, so it can be removed as a whole.
"""
