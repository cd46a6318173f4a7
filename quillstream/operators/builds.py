"""Building reference sequences: what is to be built next, what came of it, what is usable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import missing


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are given; None filters nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def next_builds(items: DataFrame, done: DataFrame, key: str, most: int, commit: int = 50, force: bool = False, **wanted) -> DataFrame:
    """The next ``most`` items by key that aren't built yet (all of them with ``force``), with the
    number of the commit that each belongs to. A build that stops is resumed by asking again:
    what was committed is in ``done``. ``most`` is small, so the rows fit one task."""
    todo = where_given(items, **wanted)
    todo = todo if force else missing(todo, done, key)
    first = todo.orderBy(key).limit(most)
    return first.withColumn("commit", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / commit).cast("int"))


def build_counters(built: DataFrame) -> DataFrame:
    """ids (null: no source had it) and unstable of each build: how many were built, flagged and
    failed, as one row."""
    has = F.col("ids").isNotNull()
    return built.agg(F.count_if(has).alias("built"), F.count_if(has & F.coalesce("unstable", F.lit(False))).alias("flagged"), F.count_if(~has).alias("failed"))


def usable(lines: DataFrame, passage: str, number: str, size: Column) -> DataFrame:
    """Lines with ids that are stable, with ``first``: the index of their first word. The index
    counts the words of all lines of the passage, also of those that are left out."""
    before = Window.partitionBy(passage).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("first", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))
    return numbered.filter(F.col("ids").isNotNull() & (F.size("ids") > 0) & ~F.coalesce("unstable", F.lit(False)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two tables hold the same rows, each as often?"""
    more, fewer = (x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")) for x, y in ((a, b), (b, a)))
    return more.union(fewer).agg((F.sum("n") == 0).alias("same"))
