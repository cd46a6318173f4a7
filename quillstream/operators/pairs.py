"""Pairs of confusingly similar lines: gram blocking, then fuzzy verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .line_pairs import scored_lines


def similar_pairs(parts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """source, target (each passage and line_no), score (0 to 1), both directions. Lines with fewer than two grams take
    no part, and grams in over ``stop_gram_df`` lines block nothing: both are features of
    the mining. A pair's score is the best ratio of the windows that start at its shared
    grams."""
    best = scored_lines(parts, p)
    score, kind = F.bround(F.col("score") / 100, 4).alias("score"), parts.schema["passage"].dataType
    line = lambda x: F.struct(F.col(f"passage_{x}").cast(kind).alias("passage"), F.col(f"line_{x}").alias("line_no"))
    ends = F.array(*(F.struct(line(x).alias("source"), line(y).alias("target")) for x, y in ("ab", "ba")))
    return best.select(F.explode(ends).alias("e"), score).select("e.source", "e.target", "score")


def pair_known(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """source, target, found: is each wanted pair in the table?"""
    have = pairs.select("source", "target").distinct().withColumn("found", F.lit(True))
    return wanted.join(have, ["source", "target"], "left").select("source", "target", F.coalesce("found", F.lit(False)).alias("found"))
