"""How alike the members of a pattern are, without comparing all pairs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.vectors import dot


def coherence(members: DataFrame, units: DataFrame) -> DataFrame:
    """``(pattern_id, vectors, coherence)``: the mean cosine over all pairs of members.

    The sum over all pairs of unit vectors is the squared length of their sum less one for each, so a pattern of
    any size is one combining sum. NULL for a pattern of one vector; members without a vector do not count.
    """
    rows = members.select("pattern_id", F.col("odi_number").alias("id")).join(units, "id")
    sums = rows.groupBy("pattern_id").agg(
        F.count("*").alias("vectors"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("_s")
    )
    n = F.col("vectors")
    return sums.select(
        "pattern_id", "vectors", F.when(n > 1, (dot(F.col("_s"), F.col("_s")) - n) / (n * (n - 1))).alias("coherence")
    )


def breaking_rank(members: DataFrame, units: DataFrame, floor: float, ranks: int = 25) -> DataFrame:
    """``(pattern_id, looked_at, breaks_at)``: the first rank whose mean cosine to all ranks before it is below ``floor``.

    Ranks follow the similarity of members with a vector, ties by report. The report looks at the first ``ranks``
    of a pattern, cut before and after the shuffle; NULL when none of them breaks.
    """
    order = Window.partitionBy("pattern_id").orderBy(F.col("similarity").desc(), "id")
    rows = members.select("pattern_id", F.col("odi_number").alias("id"), "similarity").join(units.select("id"), "id", "left_semi")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks).join(units, "id")
    before = top.select("pattern_id", F.col("rank").alias("_earlier"), F.col("vec").alias("_vec"))
    # At most `ranks` rows of a pattern on either side.
    means = (
        top.join(before, "pattern_id").filter("_earlier < rank")
        .groupBy("pattern_id", "rank").agg(F.avg(dot(F.col("vec"), F.col("_vec"))).alias("mean"))
    )
    found = means.filter(F.col("mean") < floor).groupBy("pattern_id").agg(F.min("rank").alias("breaks_at"))
    sizes = top.groupBy("pattern_id").agg(F.count("*").alias("looked_at"))
    return sizes.join(found, "pattern_id", "left")
