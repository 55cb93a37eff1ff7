"""Training-data operators: filtering, deduplication, decontamination, mixing, sharding.

Nothing outside this subpackage imports it.
"""
