"""Training-data operators: packing, sharding, filtering, deduplication and encoding at corpus scale.

Nothing outside this subpackage imports it.
"""
