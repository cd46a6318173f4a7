"""Audit of how filters interact: what each of five filters removes in every order.

A document's outcome in any order depends only on the set of filters it fails, so rows are
counted once by (part, set of failures): 32 counts a part, with those of good and of toxic rows.
Each part's counts are rows of one integer matrix, which is multiplied by four fixed incidence
matrices of 32 sets by 600 (order, step) columns: kept, removed, redundant and unique failures.

The failures A to D are expressions on the text. E needs the smallest doc_id of each text: texts
meet by sha256, minima are taken before the shuffle, and they come back by a sort-merge join
that adaptive execution can split where a third of all rows share a text.

Defined cases: null text counts as empty, null lang is the part ''; a null doc_id is neither
smaller than another nor has smaller ones, and has no labels; rows that share doc_id and text
are no copies of each other; a document counts as good (toxic) if any of its labels rows says
so; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import prepare

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS = 1 << len(FILTERS)


def incidence() -> dict[str, np.ndarray]:
    """Matrices of sets of failures by (order, step), entries 0 and 1. Bit k of a set is the filter
    FILTERS[k]."""
    names = ("kept", "removed", "redundant", "unique_fails")
    out = {n: np.zeros((SETS, len(ORDERS) * len(FILTERS)), np.int64) for n in names}
    sets, column = np.arange(SETS), 0
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, passed = (sets & bit) > 0, (sets & before) == 0
            out["removed"][:, column] = fails & passed
            out["redundant"][:, column] = fails & ~passed
            out["kept"][:, column] = ~fails & passed
            out["unique_fails"][:, column] = sets == bit
            before, column = before | bit, column + 1
    return out


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [n < 100, 100 * different < 80 * n, 100 * capitals.cast("long") > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (set of failures), n, good, toxic (long): how many documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), failures(text).alias("own"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    known = rows.join(first, "sha").join(marks, "doc_id", "left")
    fails = F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return known.groupBy("part", fails.alias("fails")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


_OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, counts (at most 32 of fails, n, good, toxic) -> 600 rows a part."""
    matrices = incidence()
    orders = pa.array(np.repeat(ORDERS, len(FILTERS)), pa.string())
    steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32())
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    for batch in batches:
        for part, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "counts")), strict=True):
            stacked = np.zeros((3, SETS), np.int64)
            for c in counts:
                stacked[:, c["fails"]] = c["n"], c["good"], c["toxic"]
            got = {n: stacked @ m for n, m in matrices.items()}
            of_filter = np.zeros(len(FILTERS), np.int64)
            np.add.at(of_filter, letters, got["removed"][0])
            columns = [*(got[n][0] for n in ("kept", "removed", "redundant", "unique_fails")), got["removed"][1], got["removed"][2], of_filter[letters]]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders), pa.string()), orders, steps, *map(pa.array, columns)], schema=_OUT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals over all orders)."""
    prepare(docs.sparkSession)
    counts = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counts"))
    return counts.mapInArrow(_outcomes, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
