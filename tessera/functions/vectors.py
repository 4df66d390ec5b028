"""Vector arithmetic as column expressions over arrays."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # As a lambda's variable the length is computed once, not once a component.
    length = F.array(F.greatest(norm(v), F.lit(TINY)))
    return F.get(F.transform(length, lambda n: F.transform(v, lambda x: (x / n).cast("float"))), F.lit(0))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def widths(df: DataFrame, vector_col: str = "embedding") -> tuple[int | None, int | None]:
    """The least and the largest width of the vectors; None of an empty table."""
    return tuple(df.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first())


def sides(queries: DataFrame, documents: DataFrame, vector_col: str = "embedding") -> tuple[int, int, int | None]:
    """The number of rows of either side, and the width that all vectors share, or ValueError. One pass over each side."""
    seen = [side.agg(F.count(F.lit(1)), F.min(F.size(vector_col)), F.max(F.size(vector_col))).first() for side in (queries, documents)]
    found = {w for s in seen for w in s[1:] if w is not None}
    if len(found) > 1:
        raise ValueError(f"vectors must be of one width, but there are widths from {min(found)} to {max(found)}")
    return seen[0][0], seen[1][0], found.pop() if found else None


def check_widths(queries: DataFrame, documents: DataFrame, vector_col: str = "embedding") -> int | None:
    """The width that all vectors of both sides share, or ValueError."""
    return sides(queries, documents, vector_col)[2]


def weighted_centroids(rows: DataFrame, key: str, weight: str, vector_col: str = "embedding") -> DataFrame:
    """(key, vector): sum of weight * vector over sum of weight, per key. Whole vectors are summed in each task and again after the shuffle: one row a key and task. Rows of no positive weight don't count, nor do keys that have no others."""
    parts = rows.where(F.col(weight) > 0).select(key, array_to_vector(F.col(vector_col)).alias("_v"), F.col(weight).cast("double").alias("_w"))
    means = parts.groupBy(key).agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
    return means.select(key, vector_to_array("_m").cast("array<float>").alias(vector_col))
