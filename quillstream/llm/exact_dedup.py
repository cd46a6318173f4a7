"""Exact deduplication by sorting contents.

Rows are range-partitioned by sampled splitters on (first bytes of the normalised text,
its sha256, doc_id) and sorted externally inside each partition, so equal texts are
neighbours. One pass per partition compares each normalised text in full with its left
neighbour and closes a run where they differ. Splitters end with doc_id, so a text that
fills a third of the table is spread over as many partitions as its share deserves; the
first and last run of each partition are then stitched to runs of other partitions by
digest and byte length. There are two such runs per partition at most, so that table is
bounded by the number of partitions and not by the data.

Equality ignores the characters ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the
most code points in the original text stays, then the smallest doc_id.

Defined cases: null text counts as empty and all such rows form one group; a null
doc_id sorts last among candidates of equal length; fully repeated rows form one group of
which exactly one row is ``kept``; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.session import materialise, partitions, prepare

#: Fixed value: the characters that equality ignores.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of the normalised text that lead the sort key; the digest follows them.
LEAD = 16

_RUNS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("length", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64()), ("points", pa.int64()), ("first", pa.bool_()), ("edge", pa.bool_()), ("head", pa.bool_()), ("part", pa.int32())])


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, points, sha, norm, lead, and row if it comes with one; a few MB
    at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [x or "" for x in part.column("text").to_pylist()]
            norm = [x.encode("utf-8", "surrogatepass").translate(None, SPACES) for x in texts]
            carried = [c for c in part.schema.names if c == "row"]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()), pa.array(norm, pa.binary()), pa.array([x[:LEAD] for x in norm], pa.binary()), *(part.column(c) for c in carried)],
                ["doc_id", "points", "sha", "norm", "lead", *carried],
            )


def _better(a: tuple, b: tuple | None) -> bool:
    """a, b: (code points, doc_id); most code points, then the smallest id, null last."""
    if b is None or a[0] != b[0]:
        return b is None or a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted doc_id, points, sha, norm -> a row per document with its run's outcome.

    ``edge`` marks the first and the last run of the partition, ``head`` one row of
    each run. A run holds ids and lengths only, and ends with its partition. Where rows come
    along, the one that stays of each run is handed on with it.
    """
    out: list[list] = [[] for _ in _RUNS]
    rows: list = []
    run: list[tuple] = []
    best, row = None, None
    last, sha, first = None, None, True
    part = TaskContext.get().partitionId()
    carried = None

    def close(edge: bool) -> None:
        chosen = run.index(best)
        for i, (points, doc) in enumerate(run):
            for column, value in zip(out, (doc, sha, len(last), best[1], len(run), best[0], i == chosen, edge, i == 0, part), strict=True):
                column.append(value)
            rows.append(row.as_py() if i == chosen and row is not None else None)

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(out, _RUNS, strict=True)]
        names = [*_RUNS.names]
        if carried is not None:
            columns.append(pa.array(rows, carried))
            names.append("row")
        for c in (*out, rows):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        ids, points, shas, norms = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "points", "sha", "norm"))
        payload = batch.column(batch.schema.get_field_index("row")) if "row" in batch.schema.names else None
        carried = None if payload is None else payload.type
        for i in range(batch.num_rows):
            norm = norms[i].as_py()
            if norm != last:
                if run:
                    close(first)
                    first = False
                    run, best = [], None
                last, sha = norm, shas[i].as_py()
            now = (points[i].as_py(), ids[i].as_py())
            run.append(now)
            if _better(now, best):
                best, row = now, None if payload is None else payload[i]
            if not i % 256 and len(out[0]) >= 2048:
                yield flush()
    if run:
        close(True)
    if out[0]:
        yield flush()


def _outcomes(docs: DataFrame, carry: bool) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha and, to ``carry``, the whole row (of the rows that
    may be kept). Shuffles each normalised text once, the rows with it if they are carried."""
    prepare(docs.sparkSession)
    more = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    ddl = StructType.fromDDL("doc_id long, points long, sha binary, norm binary, lead binary")
    found = StructType.fromDDL("doc_id long, sha binary, length long, keep_id long, size long, points long, first boolean, edge boolean, head boolean, part int")
    if carry:
        ddl, found = (StructType([*x.fields, StructField("row", docs.schema)]) for x in (ddl, found))
    normal = docs.select("doc_id", "text", *more).mapInArrow(_normal, ddl)
    n = partitions(docs)
    ordered = normal.repartitionByRange(n, "lead", "sha", "doc_id").sortWithinPartitions("lead", "sha", "norm", "doc_id").drop("lead")
    runs = materialise(ordered.mapInArrow(_runs, found), "exact-runs")
    # two rows per partition at most: the outcome of runs that may go on elsewhere
    best = F.struct(F.col("points"), F.col("keep_id").isNotNull(), -F.col("keep_id"), -F.col("part"))
    edges = runs.filter("edge and head").groupBy("sha", "length").agg(F.sum("size").alias("all_size"), F.max_by(F.struct("keep_id", "part"), best).alias("all_best"))
    joined = runs.join(F.broadcast(edges), ["sha", "length"], "left")
    edge = F.col("edge") & F.col("all_size").isNotNull()
    keep = F.when(edge, F.col("all_best.keep_id")).otherwise(F.col("keep_id"))
    kept = F.col("first") & (~edge | F.col("part").eqNullSafe(F.col("all_best.part")))
    return joined.select("doc_id", keep.alias("keep_id"), F.when(edge, F.col("all_size")).otherwise(F.col("size")).alias("group_size"), kept.alias("kept"), "sha", *(["row"] if carry else []))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _outcomes(docs, False).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: exactly one of each group of equal texts.

    Rows go through the sort as a whole, so what stays doesn't depend on doc_id naming a
    row: rows that share it but differ in their texts are groups of their own, and rows with
    a null doc_id are copies like any other (and give way to one that has an id)."""
    kept = _outcomes(docs, True).filter("kept")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
