"""Reproducible randomness: an order and an index drawn from a hash of the row key.

``rand(seed)`` depends on how rows lie in partitions; a key hash does not, so a
lost executor recomputes the same sample.
"""

from pyspark.sql import functions as F


def hash_order(seed, *keys):
    """32 hex digits, equal for equal (seed, keys), uniform over distinct keys."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts))


def hash_index(seed, size, *keys):
    """Uniform index in [0, size)."""
    number = F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("long")
    return F.pmod(number, size)
