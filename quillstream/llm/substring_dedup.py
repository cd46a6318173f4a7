"""Removal of byte strings that repeat over documents, by suffix arrays.

A byte goes if some string of ``WINDOW`` bytes that covers it also starts in a document with a smaller
doc_id. All windows are decided, whatever their number, on the input as it is:

* Texts are packed, whole, into batches of some MB, which are written once.
* Each window belongs to the least hash of the grams of ``GRAM`` bytes inside it, so equal windows meet
  wherever they stand. Neighbouring windows of one hash form a piece (about 7 pieces in 100
  bytes). Hashes are compared over ranges, a blob of sorted hashes for each batch and range, and a bit
  for each of them comes back: only pieces whose hash is in several documents go on.
* A text that a smaller doc_id has as a whole goes as a whole, before all that.
* Of pieces with one hash and one content, the smallest doc_id is kept; the others' windows are
  all covered. Different contents under one hash are a text (pieces apart by a separator) whose
  suffix array (``suffix_groups``) puts equal windows beside each other: a run of them takes
  the smallest doc_id of its pieces. Thus a suffix array holds each different content
  once.
* Hashes with more than ``LIMIT`` bytes of different contents (the edges of a passage in very many
  documents) are cut again by longer grams, at last by whole windows, which decide themselves. Their
  number grows faster than the input, so such pieces are names without bytes.
  Nothing is capped: that is how any number of contents is spread over tasks.
* Bits of removed windows go back to the batches, which are read once more and cut.

Joins are by equality, aggregates are partial first, and no task holds more than a batch, a
range of hashes (its number follows the input) or a text below the limit.

Defined cases: null text counts as empty; rows with a null doc_id are neither smaller nor larger
than others: they keep all their bytes and take none; rows that share a doc_id take nothing from
each other, but each is judged; texts shorter than a window keep all; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import at_least, discard, materialise, prepare
from .suffix_groups import suffix_arrays

#: Fixed value: bytes of a string that counts as repeated.
WINDOW = 50
#: Bytes of the grams whose least hash a window belongs to, first and for what is cut again.
GRAM, FINER = 24, (32, WINDOW)
#: Windows of a piece at most, so that they are the bits of a long.
MOST = 60
#: Bytes of a batch of texts, of a block that is hashed at once, of a hash's contents and of
#: the texts whose suffixes are sorted together.
BATCH, HASHED, LIMIT, SORTED = 4 << 20, 1 << 17, 1 << 12, 1 << 19
#: Bytes of hashes that a task compares, about.
COMPARED = 64 << 20
#: Copies whose names (a digest and a doc_id) are broadcast at most; more go through a shuffle.
FEW = 1 << 18

_ODD = np.random.default_rng(50).integers(1 << 62, size=8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; the last seven places have none."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        own = data[k : k + (len(data) - k) // 8 * 8]
        out[k::8] = np.frombuffer(own.tobytes(), np.uint64)
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram of ``gram`` bytes, from its words."""
    mixed, n = words(data), len(data) - gram + 1
    mixed ^= mixed >> np.uint64(29)
    out = mixed[:n] * _ODD[1]
    for k, at in enumerate([*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])], 2):
        out += mixed[at : at + n] * _ODD[k]
    return _mixed(out, 0)


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """One to one, and even over all values."""
    x ^= x >> np.uint64(32)
    x *= _ODD[k]
    x ^= x >> np.uint64(29)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - width + size], x[width - size :]) if width > size else x


def pieces(data: np.ndarray, ends: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other and where they end -> pieces: first window, number of
    windows, hash, text. Each window of each text is in exactly one; where a window is a gram, a
    piece is a window."""
    most = MOST if gram < WINDOW else 1
    found: list[tuple] = []
    starts = np.append(0, ends[:-1])
    for low in range(0, max(0, len(data) - WINDOW + 1), HASHED):
        block = data[low : low + HASHED + WINDOW - 1]
        least = _least(gram_hashes(block, gram), WINDOW - gram + 1)
        n = len(least)
        # texts that have windows here, and their first and last
        of = np.arange(np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + n, "left"))
        first, last = np.maximum(starts[of], low) - low, np.minimum(ends[of] - WINDOW + 1, low + n) - low
        of, first, last = (x[first < last] for x in (of, first, last))
        inside = np.zeros(n + 1, np.int8)
        inside[first] += 1
        inside[last] -= 1
        inside = np.cumsum(inside[:n]).astype(bool)
        cut = np.append(True, least[1:] != least[:-1])
        cut[first] = True
        begin = np.flatnonzero(cut & inside)
        if not len(begin):
            continue
        # least hashes are small ones: mixed again, they spread over all ranges
        text = of[np.searchsorted(first, begin, "right") - 1]
        stop = np.minimum(np.append(begin[1:], n), last[np.searchsorted(first, begin, "right") - 1])
        count = stop - begin
        parts = -(-count // most)
        rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        found.append((np.repeat(begin, parts) + low + most * rank, np.minimum(np.repeat(count, parts) - most * rank, most), np.repeat(_mixed(least[begin], 7), parts), np.repeat(text, parts)))
    if not found:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


# --- batches of texts

_BATCHES = "batch long, bytes long, ids binary, named binary, ends binary, data binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size, number = 0, TaskContext.get().partitionId() << 32

    def emit() -> pa.RecordBatch:
        ids = np.array([i or 0 for i, _ in held], np.int64)
        values = (number, size, ids.tobytes(), np.array([i is not None for i, _ in held]).tobytes(), np.cumsum([len(t) for _, t in held], dtype=np.int64).tobytes(), pa.compress(b"".join(t for _, t in held), "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], ["batch", "bytes", "ids", "named", "ends", "data"])

    for batch in batches:
        for doc, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")), strict=True):
            held.append((doc.as_py(), (text.as_py() or "").encode("utf-8", "surrogatepass")))
            size += len(held[-1][1]) + 64
            if size >= BATCH:
                yield emit()
                held, size, number = [], 0, number + 1
    if held:
        yield emit()


class Batch:
    """A batch of texts as arrays."""

    def __init__(self, row: dict):
        self.number = row["batch"].as_py()
        self.ids, self.ends = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("ids", "ends"))
        self.named = np.frombuffer(row["named"].as_buffer(), bool)
        self.data = np.frombuffer(pa.decompress(row["data"].as_buffer(), int(self.ends[-1]), "zstd"), np.uint8)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Those of texts with a doc_id: first window, number of windows, hash, doc_id."""
        start, count, hashed, text = pieces(self.data, self.ends)
        take = self.named[text]
        return start[take], count[take], hashed[take], self.ids[text[take]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def _distinct(hashed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, one of its doc_ids, whether it has several; ascending by hash."""
    order = np.argsort(hashed)
    hashed, ids = hashed[order], ids[order]
    first = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])) if len(hashed) else np.empty(0, np.int64)
    if not len(first):
        return hashed, ids, np.empty(0, bool)
    low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    return hashed[first], low, low < high


def _range_ends(hashed: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes ends among ascending hashes."""
    of = (hashed >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(of, np.arange(ranges, dtype=np.uint64), "right")


def _hashes(ranges: int):
    """A batch -> for each range its distinct hashes, with a doc_id and whether there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            _, _, hashed, ids = batch.pieces()
            hashed, low, several = _distinct(hashed, ids)
            ends = _range_ends(hashed, ranges)
            parts = [(r, s, e) for r, (s, e) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)) if s < e]
            columns = [pa.array([r for r, _, _ in parts], pa.int32()), pa.array([batch.number] * len(parts), pa.int64())]
            columns += [pa.array([x[s:e].tobytes() for _, s, e in parts], pa.binary()) for x in (hashed, low, several)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "hashes", "ids", "several"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blobs of a range -> for each batch a bit for each of its hashes: in several documents?"""
    by_part: dict[int, list[dict]] = {}
    for row in _rows(batches):
        by_part.setdefault(row["part"].as_py(), []).append(row)
    for part, own in by_part.items():
        hashed, ids, several = (np.concatenate([np.frombuffer(r[c].as_buffer(), t) for r in own]) for c, t in (("hashes", np.uint64), ("ids", np.int64), ("several", bool)))
        order = np.argsort(hashed)
        sorted_ = hashed[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
        wide = (low < high) | np.logical_or.reduceat(several[order], first)
        bits = np.empty(len(hashed), bool)
        bits[order] = np.repeat(wide, np.diff(np.append(first, len(hashed))))
        at = np.cumsum([len(r["hashes"].as_buffer()) // 8 for r in own])
        masks = [np.packbits(x).tobytes() for x in np.split(bits, at[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array([r["batch"].as_py() for r in own], pa.int64()), pa.array([part] * len(own), pa.int32()), pa.array(masks, pa.binary())], ["batch", "part", "mask"])


_PIECES = "hash long, content long, doc_id long, batch long, start long, windows int"


def _content(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _repeated(ranges: int):
    """A batch and its bits -> the pieces whose hash is in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            start, count, hashed, ids = batch.pieces()
            distinct = np.unique(hashed)
            ends = _range_ends(distinct, ranges)
            masks = dict(zip(row["parts"].values.field("part").to_pylist(), row["parts"].values.field("mask"), strict=True))
            wide = np.zeros(len(distinct), bool)
            for part, mask in masks.items():
                s, e = int(ends[part - 1]) if part else 0, int(ends[part])
                wide[s:e] = np.unpackbits(np.frombuffer(mask.as_buffer(), np.uint8), count=e - s)
            take = wide[np.searchsorted(distinct, hashed)]
            start, count, hashed, ids = (x[take] for x in (start, count, hashed, ids))
            data = batch.data.tobytes()
            contents = [_content(data[s : s + n + WINDOW - 1]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]
            columns = [hashed.view(np.int64), np.array(contents, np.int64), ids, np.full(len(ids), batch.number), start.astype(np.int64), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "content", "doc_id", "batch", "start", "windows"])

    return run


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch and pieces of it -> these with their bytes."""
    for row in _rows(batches):
        data = Batch(row).data.tobytes()
        wanted = row["wanted"].values
        cuts = zip(wanted.field("start").to_pylist(), wanted.field("windows").to_pylist(), strict=True)
        columns = [wanted.field(c) for c in ("hash", "content", "doc_id", "hot")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([data[s : s + n + WINDOW - 1] for s, n in cuts], pa.binary())], ["hash", "content", "doc_id", "hot", "data"])


# --- suffix arrays of the contents under one hash


def covered(contents: list[bytes], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Contents of several hashes, where each hash's contents start (and the end of the last), and their
    smallest doc_ids -> for each content the bits of windows that a smaller doc_id has."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    last = np.zeros(len(contents), np.int64)
    last[bounds[1:] - 1] = 1
    # contents end with a separator, a hash's last one with the smallest symbol behind it
    stops = np.cumsum(sizes + 1 + last)
    starts = stops - sizes - 1 - last
    flat = np.frombuffer(b"".join(c + (b"\0\0" if z else b"\0") for c, z in zip(contents, last.tolist(), strict=True)), np.uint8)
    symbols = flat.astype(np.int16) + 2
    symbols[starts + sizes] = 1
    symbols[stops[bounds[1:] - 1] - 1] = 0
    array = suffix_arrays(symbols, np.append(0, stops[bounds[1:] - 1]))
    of = np.repeat(np.arange(len(contents)), sizes + 1 + last)
    array = array[array + WINDOW <= (starts + sizes)[of[array]]]
    eight = words(flat)
    new = np.ones(len(array), bool)
    hash_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[of[array]]
    new[1:] = hash_of[1:] != hash_of[:-1]
    for at in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        w = eight[array + at]
        new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    mine = ids[of[array]]
    least = np.repeat(np.minimum.reduceat(mine, first), np.diff(np.append(first, len(array)))) if len(array) else mine
    out = np.zeros(len(contents), np.int64)
    smaller = array[least < mine]
    np.bitwise_or.at(out, of[smaller], np.int64(1) << (smaller - starts[of[smaller]]))
    return out


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents ordered by hash -> hash, content, bits. Texts are sorted with others of about
    their size, as a batch takes as many steps as its longest text."""
    pools: dict[int, list[tuple]] = {}
    sizes: dict[int, int] = {}
    text: list[tuple] = []

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        hashed = np.array([r[0] for r in rows], np.int64)
        bounds = np.append(np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1])), len(rows))
        bits = covered([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), bounds)
        some = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array(hashed[some]), pa.array(np.array([r[1] for r in rows], np.int64)[some]), pa.array(bits[some])], ["hash", "content", "bits"])

    def pooled() -> int:
        size = sum(len(r[3]) for r in text)
        pool = size.bit_length()
        pools.setdefault(pool, []).extend(text)
        sizes[pool] = sizes.get(pool, 0) + size
        text.clear()
        return pool

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "content", "doc_id", "data")), strict=True):
            if text and row[0] != text[-1][0] and sizes[pool := pooled()] >= SORTED:
                yield emit(pools.pop(pool))
                del sizes[pool]
            text.append(row)
    if text:
        pooled()
    # what is left over goes together where it is little
    rest: list[tuple] = []
    for pool in sorted(pools):
        rest += pools[pool]
        if sum(len(r[3]) for r in rest) >= SORTED // 2:
            yield emit(rest)
            rest = []
    if rest:
        yield emit(rest)


_BITS = "hash long, content long, bits long"
_CHILDREN = "hash long, content long, doc_id long, of_hash long, of_content long, at int, windows int"
_CONTENTS = "hash long, content long, doc_id long, hot boolean, data binary"


def _cut_again(gram: int):
    """Contents -> their pieces by a longer gram, with the content that they are of; no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column("data").to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                data = b"".join(texts)
                start, count, hashed, of = pieces(np.frombuffer(data, np.uint8), ends, gram)
                mixed = hashed ^ (part.column("hash").to_numpy().view(np.uint64)[of] * _ODD[1])
                contents = [_content(data[s : s + n + WINDOW - 1]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]
                parent = [part.column(c).to_numpy()[of] for c in ("hash", "content", "doc_id")]
                columns = [mixed.view(np.int64), np.array(contents, np.int64), parent[2], parent[0], parent[1], (start - np.append(0, ends[:-1])[of]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "content", "doc_id", "of_hash", "of_content", "at", "windows"])

    return run


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents and pieces of them -> these with their bytes."""
    for batch in batches:
        wanted, texts = pc.list_flatten(batch.column("wanted")), batch.column("data").to_pylist()
        cuts = zip(pc.list_parent_indices(batch.column("wanted")).to_pylist(), *(wanted.field(c).to_pylist() for c in ("at", "windows")), strict=True)
        columns = [wanted.field(c) for c in ("hash", "content", "doc_id", "hot")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([texts[k][s : s + n + WINDOW - 1] for k, s, n in cuts], pa.binary())], ["hash", "content", "doc_id", "hot", "data"])


def _sizes(contents: DataFrame, size) -> DataFrame:
    """hash, hot: of hashes that have several contents, not all of one document; hot if these are
    over the limit."""
    found = contents.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(size).alias("size"))
    return found.filter("low < high").select("hash", (F.col("size") > LIMIT).alias("hot"))


def resolved(contents: DataFrame, grams: tuple[int, ...] = FINER) -> DataFrame:
    """hash, content, doc_id, hot, data of hashes with several contents -> hash, content, bits of
    the windows that a smaller doc_id has, where there are any; as a table.

    What is hot grows faster than the input, and its pieces are several times as many as its
    bytes. So pieces are stored by their names alone; bytes are fetched for those only whose hash has
    several contents; each table goes as soon as nothing reads it."""
    ordered = contents.filter(~F.col("hot")).repartition("hash").sortWithinPartitions("hash").select("hash", "content", "doc_id", "data")
    out = materialise(ordered.mapInArrow(_sorted, _BITS), "substring-sorted")
    hot = contents.filter("hot")
    if not grams or not hot.limit(1).count():
        return out
    children = materialise(hot.select("hash", "content", "doc_id", "data").mapInArrow(_cut_again(grams[0]), _CHILDREN), "substring-children")
    done = [out, children]
    under = children.groupBy("hash", "content").agg(F.min("doc_id").alias("doc_id"))
    bits = F.lit(0).cast("long")  # at last a piece is a window, and its content decides
    if grams[1:]:
        place = F.min_by(F.struct("of_hash", "of_content", "at", "windows"), "doc_id")
        under = materialise(children.groupBy("hash", "content").agg(F.min("doc_id").alias("doc_id"), place.alias("place")), "substring-contents")
        several = under.join(_sizes(under, F.col("place.windows") + WINDOW - 1), "hash")
        piece = F.struct("hash", "content", "doc_id", "hot", "place.at", "place.windows")
        wanted = several.groupBy("place.of_hash", "place.of_content").agg(F.collect_list(piece).alias("wanted"))
        fetched = hot.withColumnsRenamed({"hash": "of_hash", "content": "of_content"}).join(wanted, ["of_hash", "of_content"]).select("data", "wanted")
        cut = materialise(fetched.mapInArrow(_sliced, _CONTENTS), "substring-texts")
        finer = resolved(cut, grams[1:])
        discard(cut)
        done += [under, finer]
    least = under.select("hash", "content", F.col("doc_id").alias("least"))
    known = children.join(least, ["hash", "content"])
    if grams[1:]:
        known, bits = known.join(finer, ["hash", "content"], "left"), F.coalesce("bits", F.lit(0).cast("long"))
    own = F.when(F.col("least") < F.col("doc_id"), F.expr("shiftleft(1L, windows) - 1")).otherwise(bits)
    gone = known.withColumn("bits", own).filter("bits <> 0").groupBy(F.col("of_hash").alias("hash"), F.col("of_content").alias("content")).agg(F.bit_or(F.expr("shiftleft(bits, at)")).alias("bits"))
    both = materialise(out.union(gone), "substring-windows")
    discard(*done)
    return both


# --- back to the documents

_CUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _cut(with_text: bool):
    """A batch and its removed windows -> a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            batch = Batch(row)
            flags = np.zeros(len(batch.data) + 1, np.int8)
            if row["found"].is_valid:
                found = row["found"].values
                start, bits = found.field("start").to_numpy(), found.field("bits").to_numpy()
                for k in range(MOST):
                    flags[start[(bits >> k) & 1 > 0] + k] = 1
            # covered: a removed window starts here or less than its length before
            total = np.cumsum(flags, dtype=np.int32)
            total[WINDOW:] -= total[:-WINDOW].copy()
            gone = total[:-1] > 0
            starts = np.append(0, batch.ends[:-1])
            edge = np.append(False, gone[1:] != gone[:-1])
            edge[starts[starts < len(gone)]] = True
            begin = np.flatnonzero(edge) if len(gone) else np.empty(0, np.int64)
            stop = np.append(begin[1:], len(gone))
            begin, stop = begin[gone[begin]], stop[gone[begin]]
            of = np.searchsorted(batch.ends, begin, "right")
            per = np.bincount(of, minlength=len(batch.ids))
            spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(per)).astype(np.int32), pa.StructArray.from_arrays([pa.array(begin - starts[of]), pa.array(stop - starts[of])], fields=list(_SPAN)))
            removed = np.bincount(of, weights=stop - begin, minlength=len(batch.ids)).astype(np.int64)
            kept = [batch.data[s:e][~gone[s:e]].tobytes() for s, e in zip(starts.tolist(), batch.ends.tolist(), strict=True)]
            columns = [pa.array(batch.ids, mask=~batch.named), pa.array(batch.ends - starts), pa.array(removed), spans, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _copies(texts: DataFrame) -> DataFrame:
    """doc_id, sha, n_bytes and, of texts shorter than a window, the text: of rows whose whole text a
    smaller doc_id has."""
    short = F.when(F.octet_length("text") < WINDOW, F.col("text"))
    small = texts.filter("doc_id is not null").select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), short.alias("short"))
    first = small.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return small.join(first, "sha").filter("doc_id > first").drop("first")


def _whole(copies: DataFrame, with_text: bool) -> DataFrame:
    """The result for copies: all of it goes, or none if it is shorter than a window."""
    n, gone = F.col("n_bytes"), F.col("short").isNull()
    spans = F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    columns = ["doc_id", "n_bytes", F.when(gone, n).otherwise(0).alias("n_removed"), spans.alias("spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256")]
    return copies.select(*columns, *([F.coalesce("short", F.lit("")).cast("binary").alias("kept")] if with_text else []))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed runs, in bytes from the
    document's start), kept_sha256, and the bytes that are left in ``kept``, if asked for."""
    spark = prepare(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    copies = materialise(_copies(named), "substring-copies")
    # where their names are few, texts aren't shuffled to leave them out
    names = copies.select("doc_id", "sha")
    few = copies.count() <= FEW
    others = named.join(F.broadcast(names) if few else names, ["doc_id", "sha"], "left_anti").select("doc_id", "text")
    packed = materialise(others.mapInArrow(_packed, _BATCHES), "substring-batches")
    size = packed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    ranges = at_least(spark, size // COMPARED + 1)
    hashes = packed.mapInArrow(_hashes(ranges), "part int, batch long, hashes binary, ids binary, several binary")
    bits = materialise(hashes.repartitionById(ranges, F.col("part")).mapInArrow(_compared, "batch long, part int, mask binary"), "substring-bits")
    parts = bits.groupBy("batch").agg(F.collect_list(F.struct("part", "mask")).alias("parts"))
    repeated = materialise(packed.join(parts, "batch").mapInArrow(_repeated(ranges), _PIECES), "substring-pieces")
    discard(bits)
    first = F.min_by(F.struct("batch", "start", "windows"), "doc_id")
    contents = materialise(repeated.groupBy("hash", "content").agg(F.min("doc_id").alias("doc_id"), first.alias("place")), "substring-contents")
    several = contents.join(_sizes(contents, F.col("place.windows") + WINDOW - 1), "hash")
    wanted = several.groupBy("place.batch").agg(F.collect_list(F.struct("hash", "content", "doc_id", "hot", "place.start", "place.windows")).alias("wanted"))
    wanted = materialise(wanted, "substring-wanted")
    cut = materialise(packed.join(wanted, "batch").mapInArrow(_fetched, _CONTENTS), "substring-texts")
    discard(wanted)
    inner = resolved(cut)
    discard(cut)
    least = contents.select("hash", "content", F.col("doc_id").alias("least")).join(inner, ["hash", "content"], "left")
    own = F.when(F.col("least") < F.col("doc_id"), F.expr("shiftleft(1L, windows) - 1")).otherwise(F.coalesce("bits", F.lit(0).cast("long")))
    gone = repeated.join(least, ["hash", "content"]).select("batch", "start", own.alias("bits")).filter("bits <> 0")
    found = materialise(gone.groupBy("batch").agg(F.collect_list(F.struct("start", "bits")).alias("found")), "substring-found")
    discard(repeated, contents, inner)
    rest = packed.join(found, "batch", "left").mapInArrow(_cut(with_text), _CUT + (", kept binary" if with_text else ""))
    return rest.union(_whole(copies, with_text))
