"""Substring search that opens only the blocks of rows which can hold what is asked for.

The index has, for each block of rows (a range of ids), the trigrams of the block's texts, lower-cased.
A literal of three letters or more can only be in blocks that have all its trigrams; shorter ones are
in any block. Candidates are blocks by an equi-join on trigrams and a count, rows of these are
read, and ``contains`` decides. Any number of literals is one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import materialise, prepare

SIZE = 3


def _grams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    n = F.length(text)
    starts = F.when(n >= SIZE, F.sequence(F.lit(1), n - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(SIZE))))


def block_of(id_: Column, rows: int) -> Column:
    return F.floor(id_ / rows)


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, t -> the distinct trigrams of a few texts of a block at a time."""
    for batch in batches:
        found: dict[int, set[str]] = {}
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py()
            found.setdefault(block, set()).update(t[i : i + SIZE] for i in range(len(t) - SIZE + 1))
        for block, grams in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(sorted(grams), pa.string()), pa.array([block] * len(grams), pa.int64())], ["gram", "block"])


def index(docs: DataFrame, id_: str, text: str, rows: int = 64) -> DataFrame:
    """gram, block: which trigrams the texts of a block have."""
    prepare(docs.sparkSession)
    of = docs.select(block_of(F.col(id_), rows).alias("block"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return of.mapInArrow(_block_grams, "gram string, block long").distinct()


def blocks(found: DataFrame, asked: DataFrame, every: DataFrame) -> DataFrame:
    """asked: query, literal -> query, block of the blocks that can hold it. ``every``: all blocks."""
    low = asked.select("query", F.lower("literal").alias("literal"))
    grams = low.select("query", F.explode(_grams(F.col("literal"))).alias("gram"))
    need = grams.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    have = grams.join(found, "gram").groupBy("query", "block").agg(F.count(F.lit(1)).alias("have"))
    able = have.join(need, "query").filter("have = need").select("query", "block")
    short = low.filter(F.length("literal") < SIZE).select("query")
    return able.union(_anywhere(short, every))


#: Literals whose trigrams every task holds, and pairs of a literal and a block that are broadcast, at most.
HELD, FEW = 1 << 12, 1 << 18


def blocks_once(docs: DataFrame, asked: DataFrame, id_: str, text: str, rows: int = 64) -> DataFrame:
    """``blocks`` of docs that are indexed for these literals alone: the trigrams of a few texts of a
    block are made and looked through in one task, and none is shuffled. A text that has a literal has
    all its trigrams, so texts of a block needn't meet. More literals than ``HELD`` go through an index."""
    prepare(docs.sparkSession)
    low = asked.select("query", F.lower("literal").alias("literal"))
    held = [tuple(r) for r in low.limit(HELD + 1).collect()]
    if len(held) > HELD:
        return blocks(index(docs, id_, text, rows), asked, docs.select(block_of(F.col(id_), rows).alias("block")).distinct())
    need = [(q, frozenset(t[i : i + SIZE] for i in range(len(t) - SIZE + 1))) for q, t in held if t is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set[str]] = {}
            for block, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(block, set()).update(map("".join, zip(*(t[j:] for j in range(SIZE)), strict=False)))
            out = [(q, block) for block, grams in found.items() for q, own in need if own <= grams]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["query", "block"])

    of = docs.select(block_of(F.col(id_), rows).alias("block"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return of.filter("block is not null").mapInArrow(run, "query long, block long").distinct()


def search_once(docs: DataFrame, asked: DataFrame, id_: str, text: str, rows: int = 64) -> DataFrame:
    """``search`` without a stored index. Where the blocks to open are few, texts aren't shuffled."""
    own = docs.select(F.col(id_).alias("id"), F.col(text).alias("t"), block_of(F.col(id_), rows).alias("block"))
    able = materialise(blocks_once(docs, asked, id_, text, rows).join(asked, "query"), "substring-blocks")
    able = F.broadcast(able) if able.count() <= FEW else able
    return own.join(able, "block").filter(F.lower("t").contains(F.lower("literal"))).select("query", "id")


def _anywhere(short: DataFrame, every: DataFrame) -> DataFrame:
    """Literals that have no trigram, with each block, by a join on one key."""
    return short.withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").select("query", "block")


def search(docs: DataFrame, found: DataFrame, asked: DataFrame, id_: str, text: str, rows: int = 64) -> DataFrame:
    """query, id of the rows whose text has the query's literal, whatever the case. ``found``: the
    ``index`` of docs by the same ``rows``."""
    own = docs.select(F.col(id_).alias("id"), F.col(text).alias("t"), block_of(F.col(id_), rows).alias("block"))
    every = own.select("block").distinct()
    able = blocks(found, asked, every).join(asked, "query")
    return own.join(able, "block").filter(F.lower("t").contains(F.lower("literal"))).select("query", "id")
