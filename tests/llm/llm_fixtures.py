"""Small tables with the awkward rows that every operator has to take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string"


def words(rng, n, vocabulary=60):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.choice('eiou')}{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, extra=()):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names."""
    rng = random.Random(3)
    base = words(rng, 80)
    rows = [
        (1, base, "en"), (2, base.upper(), "en"), (3, base + " more words here", "fr"), (4, None, None), (5, "", "en"),
        (6, " \t\n ", "en"), (7, "Éa ÀB", "fr"), (8, "éa àb", "fr"), (9, words(rng, 3), None), (9, words(rng, 3), None),
        (10, base, "en"), (10, base, "en"), (None, base, "en"), (None, None, None), (11, words(rng, 40_000), "en"),
        (12, "one", "en"), (13, "one two", "en"), *extra,
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "_id", "row", "fp", "keep_id", "text_sha256", "_text", "sig", "score", "start", "n", "path", "blob"):
        df = df.withColumn(name, F.lit("clash"))
    return rows, df


def no_rows(df):
    return df.filter("false")
