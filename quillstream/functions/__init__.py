"""Column functions; ``register`` makes the scalars callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .similarity import edit_distance, ratio


def register(spark: SparkSession) -> None:
    from ..sources.session import prepare

    prepare(spark)
    spark.udf.register("lcs_ratio", ratio, "double")
    spark.udf.register("id_edit_distance", edit_distance, "int")
