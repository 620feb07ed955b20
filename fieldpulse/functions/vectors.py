"""Vector expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """``[a,b,...]`` text form to an array."""
    return F.from_json(text, "array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised copy; a zero vector is returned unchanged."""
    wide = v.cast("array<double>")
    return F.element_at(
        F.transform(
            F.array(norm(wide)),
            # Adding zero turns -0.0 into 0.0, so that equal vectors are also identical.
            lambda n: F.transform(wide, lambda x: F.when(n > 0, x / n).otherwise(x) + F.lit(0.0)),
        ),
        1,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two unit vectors."""
    return dot(a, b)


def centroids(df: DataFrame, key: str, vector: str, name: str = "centroid") -> DataFrame:
    """Unit-length mean of the raw (not normalised) vectors of each key.

    The mean is a partial aggregate of one vector per key and task, so a hot key
    never gathers its rows in one place.
    """
    raw = F.col(vector).cast("array<double>")
    means = (
        df.filter(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(vector_to_array(Summarizer.mean(array_to_vector(raw))).alias(name))
    )
    return means.withColumn(name, unit(F.col(name)))
