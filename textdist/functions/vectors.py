"""Vector columns held as ``array<double>``."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F


def as_doubles(col):
    return col.cast("array<double>")


def euclidean(x, y):
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def row_norm(x, norm):
    part = (lambda v: v * v) if norm == "l2" else F.abs
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + part(v))
    return F.sqrt(total) if norm == "l2" else total


def normalized(x, norm="l2"):
    """Unit rows; a zero row stays zero. ``norm`` is 'l2', 'l1', 'none' or None."""
    if norm in (None, "none"):
        return x
    if norm not in ("l2", "l1"):
        raise ValueError(f"unknown norm {norm!r}")
    size = row_norm(x, norm)
    # The norm goes in as an array so it is computed once per row, not once per element.
    divisor = F.array_repeat(F.when(size == 0, F.lit(1.0)).otherwise(size), F.size(x))
    return F.zip_with(x, divisor, lambda v, n: v / n)


def to_ml(x):
    return array_to_vector(x)


def from_ml(v):
    return vector_to_array(v)
