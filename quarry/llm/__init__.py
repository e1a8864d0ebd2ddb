"""Operators for large training corpora: filtering, de-duplication, mixing, sharding, packing, search."""
