"""Hard negatives by blocked matrix products.

Anchors (every ``EVERY``-th id) are packed into blocks of ``BLOCK`` rows or a little more, blocks into
groups of at most ``GROUP_BYTES``. A group is broadcast to the candidates, which stay where they are read and
are packed the same way; each pair of blocks is one product in float64. Components are whole
numbers, so a product is exact while the norms allow no sum of 2^53 or more; pairs of blocks
past that bound are multiplied as unbounded integers.

Two passes over the candidates: the first keeps each anchor's ``POSITIVES`` best rows of its own
label, the second, for each of these, the ``NEGATIVES`` best rows of other labels whose score lies in
its window. What a task keeps are lists of that length for each anchor and window, which merge:
tasks hand them on, and a ranking window with a limit merges them. A score enters only if it
reaches the last place of a list, so nearly all are dropped by comparison. The work is
the number of anchors times the number of rows, as every pair of them is scored; groups are
jobs of their own, so the broadcast and a task's lists stay bounded.

Defined cases: rows with a null id, null label, null vector, or a null or non-finite component take
no part; vectors of different lengths have no score and are not compared; an anchor's other rows
are those with another id, and each of several rows with an anchor's id is an anchor that
returns rows of its own; ties go to the smaller id; a score past 64 bits is an error; an empty
table gives an empty result; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import discard, materialise, prepare, shared_dir

#: Fixed values of the contract.
EVERY, POSITIVES, NEGATIVES, SCALE, RELABEL, LABELS = 50, 5, 3, 256, 7, 10
#: A negative scores from LOW to HIGH hundredths of the positive.
LOW, HIGH = 50, 95
#: Rows of a block, candidates that meet it at once, and bytes of the anchors that are broadcast.
BLOCK, SLICE, GROUP_BYTES = 4096, 512, 32 << 20
#: Sums below this are exact in float64.
EXACT = float(1 << 53)

_PACKED = "blocks long, dim int, ids binary, labels binary, matrix binary"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding (double components), label of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good).withColumn("label", label)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows -> blocks of rows whose vectors have one length, with a number that no other block of
    this table has."""
    held: dict[int, list[tuple]] = {}
    number = TaskContext.get().partitionId() << 32

    def emit(dim: int) -> pa.RecordBatch:
        nonlocal number
        parts, number = held.pop(dim), number + 1
        ids, labels, matrix = (np.concatenate([p[k] for p in parts]) for k in range(3))
        values = [[number], [dim], [ids.tobytes()], [labels.tobytes()], [matrix.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["blocks", "dim", "ids", "labels", "matrix"])

    for batch in batches:
        ids, labels = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        vectors = batch.column(batch.schema.get_field_index("embedding"))
        ends = np.asarray(vectors.offsets)
        flat = vectors.values.to_numpy(zero_copy_only=False)[: ends[-1]]
        lengths = np.diff(ends)
        for dim in map(int, np.unique(lengths)):
            rows = np.flatnonzero(lengths == dim)
            matrix = np.floor(SCALE * flat[ends[rows][:, None] + np.arange(dim)])
            most = max(1, min(BLOCK, GROUP_BYTES // (8 * max(dim, 1))))
            for at in range(0, len(rows), most):
                held.setdefault(dim, []).append((ids[rows[at : at + most]], labels[rows[at : at + most]], matrix[at : at + most]))
                if sum(len(p[0]) for p in held[dim]) >= most:
                    yield emit(dim)
    for dim in list(held):
        yield emit(dim)


def pack(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_packed, _PACKED)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: float64 below 2^53, else Python integers."""
    norms = [np.sqrt((x * x).sum(axis=1)).max(initial=0) for x in (a, b)]
    if norms[0] * norms[1] < EXACT / 2:
        return a @ b.T
    whole = [np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) for x in (a, b)]
    out = whole[0] @ whole[1].T
    if any(abs(v) >= 1 << 63 for v in out.flat):
        raise OverflowError("an inner product needs more than 64 bits")
    return out


class Best:
    """The ``keep`` best (score, id) for each anchor of a block and each of its windows."""

    def __init__(self, block: dict, keep: int, same: bool):
        self.number, self.keep, self.same = block["blocks"], keep, same
        self.ids = np.frombuffer(block["ids"], np.int64)
        self.labels = np.frombuffer(block["labels"], np.int64)
        self.matrix = np.frombuffer(block["matrix"]).reshape(len(self.ids), block["dim"])
        n, windows = len(self.ids), 1 if same else POSITIVES
        self.low = np.full((n, windows), -(1 << 63) if same else 1, np.int64)
        self.high = np.full((n, windows), (1 << 63) - 1 if same else 0, np.int64)
        for m in block.get("marks") or ():
            # 50 p <= 100 s <= 95 p, in whole numbers
            at, score = (m["anchor"], m["place"]), m["score"]
            self.low[at], self.high[at] = -(-LOW * score // 100), HIGH * score // 100
        self.lists = [(np.empty(0, np.int64),) * 3 for _ in range(windows)]

    def add(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        for at in range(0, len(ids), SLICE):
            part = slice(at, at + SLICE)
            self._add(ids[part], labels[part], matrix[part])

    def _add(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        got = scores(self.matrix, matrix)
        alike = self.labels[:, None] == labels
        fits = alike & (self.ids[:, None] != ids) if self.same else ~alike
        for k, (anchors, held, names) in enumerate(self.lists):
            inside = fits & (got >= self.low[:, k, None]) & (got <= self.high[:, k, None])
            rows, columns = np.nonzero(inside)
            if not len(rows):
                continue
            anchors, held, names = (np.concatenate(x) for x in ((anchors, rows), (held, got[rows, columns].astype(np.int64)), (names, ids[columns])))
            order = np.lexsort((names, -held, anchors))
            anchors, held, names = anchors[order], held[order], names[order]
            starts = np.searchsorted(anchors, anchors)
            first = np.arange(len(anchors)) - starts < self.keep
            anchors, held, names = anchors[first], held[first], names[first]
            self.lists[k] = (anchors, held, names)
            # a full list lets in what reaches its last place
            sizes = np.bincount(anchors, minlength=len(self.ids))
            last = np.cumsum(sizes)[sizes == self.keep] - 1
            self.low[sizes == self.keep, k] = held[last]

    def result(self) -> pa.RecordBatch:
        place = np.concatenate([np.full(len(x[0]), k, np.int32) for k, x in enumerate(self.lists)])
        anchors, held, names = (np.concatenate([x[k] for x in self.lists]) for k in range(3))
        columns = [np.full(len(anchors), self.number), anchors.astype(np.int32), self.ids[anchors], place, held, names]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["blocks", "anchor", "anchor_id", "place", "score", "vec_id"])


def _matched(keep: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                number = row["blocks"].as_py()
                if number not in best:
                    best[number] = Best({c: row[c].as_py() for c in row if not c.startswith("other_")}, keep, same)
                ids, labels = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("other_ids", "other_labels"))
                best[number].add(ids, labels, np.frombuffer(row["other_matrix"].as_buffer()).reshape(len(ids), row["dim"].as_py()))
        yield from (b.result() for b in best.values())

    return run


_FOUND = "blocks long, anchor int, anchor_id long, place int, score long, vec_id long"


def _pass(candidates: DataFrame, anchors: DataFrame, groups: list[list[int]], keep: int, same: bool) -> DataFrame:
    """The merged lists of all groups: _FOUND and rank."""
    spark = candidates.sparkSession
    path = f"{shared_dir(spark)}/negatives-lists-{uuid.uuid4().hex}"
    spark.createDataFrame([], _FOUND).write.parquet(path)
    for numbers in groups:
        block = anchors.filter(F.col("blocks").isin(numbers))
        others = pack(candidates).select("dim", F.col("ids").alias("other_ids"), F.col("labels").alias("other_labels"), F.col("matrix").alias("other_matrix"), F.explode(F.array(*map(F.lit, numbers))).alias("blocks"))
        met = others.join(F.broadcast(block), ["blocks", "dim"])
        met.mapInArrow(_matched(keep, same), _FOUND).write.mode("append").parquet(path)
    every = spark.read.schema(_FOUND).parquet(path)
    every.scratch = path
    best = Window.partitionBy("blocks", "anchor", "place").orderBy(F.desc("score"), "vec_id")
    out = materialise(every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep), "negatives-best")
    discard(every)
    return out


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and
    each of its positives the best rows of other labels that score from half to 95 % of it."""
    spark = prepare(embeddings.sparkSession)
    rows = usable(embeddings)
    chosen = rows.filter(F.col("vec_id") % EVERY == 0)
    size = chosen.agg(F.coalesce(F.sum(64 + 8 * F.size("embedding").cast("long")), F.lit(0))).first()[0]
    spread = max(1, -(-size // GROUP_BYTES))
    anchors = materialise(pack(chosen.repartition(spread)), "negatives-anchors")
    sizes = anchors.select("blocks", (F.length("matrix") + F.length("ids")).alias("bytes")).orderBy("blocks").collect()  # a row for 4,096 anchors
    groups: list[list[int]] = []
    room = 0
    for number, own in sizes:
        if own > room:
            groups.append([])
            room = max(GROUP_BYTES, own)
        groups[-1].append(number)
        room -= own
    positives = _pass(rows, anchors, groups, POSITIVES, True)
    place = F.col("rank") - 1
    marks = positives.groupBy("blocks").agg(F.collect_list(F.struct("anchor", place.alias("place"), "score")).alias("marks"))
    windows = materialise(anchors.join(marks, "blocks"), "negatives-windows")
    negatives = _pass(rows, windows, groups, NEGATIVES, False)
    discard(anchors, windows)
    of = positives.select("blocks", "anchor", place.alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["blocks", "anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
