"""Token ids in directly addressable files.

An id is split into chunks of 8 bits, lowest first. Level 0 has a chunk for each token,
level k + 1 one for each token whose level-k chunk goes on. A bitmap per level says which
go on, and a rank directory holds the number of set bits before each block of 512. Token
i of a segment is read by following rank(i) through the levels: at most one chunk, one
bit and one block's population count a level, whatever the token's place. No block is
decoded for that.

A segment is the unit of the format: some documents in doc_id order with their ids,
offsets and levels, self-contained in one binary value. Segments go to the shared folder
through Spark's own committer (one Parquet row a segment, uncompressed), so a lost
executor's task is written again and no half file is ever read.

Segment layout, little-endian: ``DAC8``, u32 documents, u64 tokens, u32 levels; documents x
u8 (1: doc_id is null), documents x i64, (documents + 1) x u64 first tokens; then for each level
u64 chunks, the chunks, the bitmap padded to whole blocks, and a u64 rank per block.

Defined cases: null text counts as empty; every document ends with the end id, so none is
empty; a null doc_id sorts first; rows with the same doc_id follow each other, ordered
by the start of their texts and then by a hash of the whole; an empty table gives no segment and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.session import partitions, prepare, shared_dir
from .encoding import encoder

END = 0
#: Tokens after which a segment closes (a single longer document makes it longer).
SEGMENT = 1 << 19
BLOCK = 512
#: Characters of a text that order the rows of one doc_id.
LEAD = 16
_HEAD = struct.Struct("<4sIQI")
_WRITTEN = "part int, segment int, first long, tokens long, payload binary"


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32)
    levels, out = [], []
    while True:
        on = flat > 255
        levels.append(((flat & 255).astype(np.uint8), on))
        if not on.any():
            break
        flat = flat[on] >> 8
    out.append(_HEAD.pack(b"DAC8", len(ids), int(offsets[-1]), len(levels)))
    out += [np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), offsets.tobytes()]
    for chunks, on in levels:
        blocks = -(-len(on) // BLOCK)
        bits = np.packbits(np.pad(on, (0, blocks * BLOCK - len(on))), bitorder="little")
        ones = np.bitwise_count(bits.reshape(blocks, -1)).sum(1, dtype=np.uint64) if blocks else np.empty(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if blocks else np.empty(0, "<u8")
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """A segment's views; ``token(i)`` is the random access, ``ids(d)`` one document."""

    def __init__(self, data: bytes):
        magic, docs, self.tokens, levels = _HEAD.unpack_from(data)
        if magic != b"DAC8":
            raise ValueError("not a segment")
        at = _HEAD.size
        null = np.frombuffer(data, np.uint8, docs, at)
        doc_ids = np.frombuffer(data, "<i8", docs, at := at + docs)
        self.doc_ids = [None if n else int(d) for n, d in zip(null, doc_ids, strict=True)]
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at := at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at := at + n)
            ranks = np.frombuffer(data, "<u8", blocks, at := at + len(bits))
            at += 8 * blocks
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block, first = i // BLOCK, i // BLOCK * BLOCK // 8
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        return int(ranks[block]) + whole + int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count()

    def token(self, i: int) -> int:
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end - 1: the same walk for a run of neighbours at once."""
        out = np.zeros(end - start, "<u4")
        where = np.arange(end - start)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << (8 * level)
            on = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            where = where[on]
            start = self._rank(bits, ranks, start)
            end = start + len(where)
        return out

    def ids(self, doc: int) -> np.ndarray:
        return self.slice(int(self.offsets[doc]), int(self.offsets[doc + 1]))


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([END], code.dtype).tobytes()
        docs, ids, held, first, number = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = [[part], [number], [first], [held], [write_segment(docs, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "first", "tokens", "payload"])

        with code:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    sub = batch.slice(at, 64)
                    found = code.encode([x or "" for x in sub.column("text").to_pylist()])
                    for doc, raw in zip(sub.column("doc_id").to_pylist(), found, strict=True):
                        docs.append(doc)
                        ids.append(np.frombuffer(raw + end, code.dtype))
                        held += len(ids[-1])
                        if held >= SEGMENT:
                            yield close()
                            first, number = first + held, number + 1
                            docs, ids, held = [], [], 0
            if docs:
                yield close()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, first, payload in zip(*(batch.column(c) for c in ("part", "first", "payload")), strict=True):
            segment, before = Segment(payload.as_py()), first.as_py()
            flat = segment.slice(0, segment.tokens).tobytes()
            ends = segment.offsets.astype(np.int64)
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            n = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * n, pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(ends[:-1] + before), pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                ["part", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None) -> str:
    """Encode all documents, write their segments in ascending doc_id order and return
    the folder. One shuffle, of the texts, by ranges of doc_id and text."""
    spark = prepare(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    n = partitions(docs)
    # a doc_id that fills a third of the table is spread by its texts, which come next in order
    named = docs.select("doc_id", "text", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("hash"))
    ordered = named.repartitionByRange(n, "doc_id", "lead", "hash").sortWithinPartitions("doc_id", "lead", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(_write(vocabulary), _WRITTEN).write.option("compression", "none").parquet(folder)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files."""
    segments = spark.read.schema(_WRITTEN).parquet(folder)
    # a row per written partition: its tokens, and those of the partitions before it
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    found = segments.select("part", "first", "payload").mapInArrow(_read, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    return read_tokens(docs.sparkSession, write_tokens(docs, vocabulary))
