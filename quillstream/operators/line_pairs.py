"""Pairs of lines that share a gram and are alike behind it, on chunks of numbered words.

Grams with their windows are many times the texts, so they are never a table. Texts are written once as
chunks (words as numbers, with the chunk's vocabulary), and everything else is made from these inside tasks:

1. counted: digests (96 bits) of a chunk's different grams go to the task of their part, which adds up
   in how many lines each is and returns a bit for each of them: few enough lines, and more than one;
2. marked: these bits become bits of the chunk's words;
3. paired: only marked grams go on, with their windows; all of a gram's lines meet in one task, which
   scores each pair of different windows once. A pair of windows starts with the same gram, so
   it is met in no other task.

1 and 3 are taken in ``PASSES``, by digests, and the shuffle of a pass goes before the next one. Two
lines that are alike from some word on tell so once, not at every gram.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import lcs_all
from ..params import Params
from ..sources.session import at_least, discard, materialise, prepare
from .corpus import words

PASSES = 3
#: Grams of a pass whose lines are counted in one task, about.
_PER_TASK = 1 << 20
#: Marked grams that are paired at once, and pairs of windows that are scored at once.
_AT_ONCE = 1 << 16

_CHUNK = "chunk long, n long, ids binary, vocabulary array<string>, sizes binary, line_no binary, passage binary, known binary, live binary"
_FIELDS = [x.split()[0] for x in _CHUNK.split(", ")]
_PAIR = "passage_a long, line_a int, passage_b long, line_b int, score double"
_EMPTY = np.zeros(0, np.int64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}


def _batch(columns: dict, like: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if like is None else pa.array(v, like.field(k).type) for k, v in columns.items()], list(columns))


# ---------------------------------------------------------------- chunks

_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vocabulary", pa.list_(pa.string())), ("sizes", pa.binary()), ("line_no", pa.binary()), ("passage", pa.binary()), ("known", pa.binary()), ("live", pa.binary())])


def _chunks(least: int):
    """passage, first (number of the first line), lines -> chunks; lines of fewer words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.list_flatten(batch.column(2))
            sizes = np.asarray(pc.list_value_length(lines).fill_null(0), np.int64)
            keep = sizes >= least
            if not keep.any():
                continue
            coded = pc.list_flatten(lines).dictionary_encode()
            ids = np.asarray(coded.indices)[np.repeat(keep, sizes)]
            vocabulary = coded.dictionary
            counts = np.asarray(pc.list_value_length(batch.column(2)).fill_null(0), np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.asarray(batch.column(1), np.int64)[row]
            passage = np.asarray(batch.column(0).fill_null(0), np.int64)[row]
            known = np.asarray(batch.column(0).is_valid().cast(pa.uint8()))[row]
            wide = np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32
            yield _batch({
                "chunk": [int.from_bytes(os.urandom(8)) >> 1], "n": [len(ids)], "ids": [ids.astype(wide).tobytes()], "vocabulary": [vocabulary.to_pylist()], "sizes": [sizes[keep].astype(np.int32).tobytes()],
                "line_no": [number[keep].astype(np.int32).tobytes()], "passage": [passage[keep].tobytes()], "known": [known[keep].tobytes()], "live": [None],
            }, _CHUNK_ARROW)

    return run


class _Chunk:
    def __init__(self, row: dict):
        self.vocabulary = row["vocabulary"]
        self.ids = np.frombuffer(row["ids"], np.uint16 if len(self.vocabulary) <= 1 << 16 else np.uint32)
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        #: behind the last word of each word's line
        self.end = np.repeat(np.cumsum(self.sizes), self.sizes)

    def grams(self, n: int, turn: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the grams of n words (of one pass, if asked for), in order, and their digests of
        64 and 32 bits."""
        own = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in self.vocabulary), np.uint64).reshape(-1, 2)

        def digests(at: np.ndarray, lane: int, factor: int) -> np.ndarray:
            by_word = np.ascontiguousarray(own[:, lane])[self.ids]
            total = by_word[at]
            for k in range(1, n):
                total = total * np.uint64(factor) + by_word[at + k]
            total ^= total >> np.uint64(32)
            total *= np.uint64(0xD6E8FEB86659FD93)
            return total ^ total >> np.uint64(32)

        at = np.flatnonzero(np.arange(len(self.ids)) + n <= self.end)
        high = digests(at, 0, 0x9E3779B97F4A7C15)
        if turn >= 0:
            chosen = _turn(high) == turn
            at, high = at[chosen], high[chosen]
        return at, high, (digests(at, 1, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)


def _turn(high: np.ndarray) -> np.ndarray:
    """The pass of a gram."""
    return (high >> np.uint64(40)) % np.uint64(PASSES)


def _part(high: np.ndarray, parts: int) -> np.ndarray:
    """The task of a gram, in its pass."""
    return (high % np.uint64(parts)).astype(np.int64)


def _by_gram(high: np.ndarray, low: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams in the order of their digests and then of their places, without repeats inside of a
    line, and where each different one begins."""
    order = np.argsort(high, kind="stable")
    h, g = high[order], low[order]
    if np.any((h[1:] == h[:-1]) & (g[1:] != g[:-1])):
        order = np.lexsort((low, high))
        h, g = high[order], low[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    fresh, lines = new.copy(), line[order]
    fresh[1:] |= lines[1:] != lines[:-1]
    return order[fresh], np.flatnonzero(new[fresh])


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part, in order."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for at, to in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(part[order[at]]), order[at:to]


# ---------------------------------------------------------------- 1. counted


def _counted(n: int, parts: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row)
            at, high, low = chunk.grams(n, turn)
            if not len(at):
                continue
            order, starts = _by_gram(high, low, chunk.line[at])
            lines = np.minimum(np.diff(starts, append=len(order)), 0xFFFFFFFF).astype(np.uint32)
            high, low = high[order[starts]], low[order[starts]]
            found = [(k, high[x].tobytes(), low[x].tobytes(), lines[x].astype(np.uint8 if lines[x].max() < 256 else np.uint32).tobytes()) for k, x in _dealt(_part(high, parts))]
            yield _batch({"part": pa.array([x[0] for x in found], pa.int32()), "chunk": pa.array([row["chunk"]] * len(found), pa.int64()), "high": [x[1] for x in found], "low": [x[2] for x in found], "lines": [x[3] for x in found]})

    return run


def _few(stop: int, parts: int, turn: int):
    """Digests of a part from all chunks -> for each chunk, a bit for each of its grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(_rows(batches))
        if not rows:
            return
        high = np.concatenate([np.frombuffer(r["high"], np.uint64) for r in rows])
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
        sizes = [len(r["high"]) // 8 for r in rows]
        lines = np.concatenate([np.frombuffer(r["lines"], np.uint8 if len(r["lines"]) == k else np.uint32).astype(np.int64) for r, k in zip(rows, sizes, strict=True)])
        order, starts = _by_gram(high, low, np.arange(len(high)))
        total = np.add.reduceat(lines[order], starts)
        live = np.zeros(len(high), bool)
        live[order] = np.repeat((total >= 2) & (total <= stop), np.diff(starts, append=len(order)))
        ends = np.cumsum(sizes)
        bits = [np.packbits(live[to - k : to]).tobytes() for k, to in zip(sizes, ends, strict=True)]
        yield _batch({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "n": pa.array([turn * parts + r["part"] for r in rows], pa.int64()), "live": bits})

    return run


# ---------------------------------------------------------------- 2. marked


def _marked(n: int, parts: int):
    """A chunk and the bits of its parts behind it -> the chunk with a bit for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None

        def done():
            live = np.zeros(len(chunk.ids), bool)
            live[at[order[np.repeat(entry, spread)]]] = True
            return _batch({name: [np.packbits(live).tobytes() if name == "live" else row[name]] for name in _FIELDS}, _CHUNK_ARROW)

        for r in _rows(batches):
            if r["role"] == 0:
                if chunk is not None:
                    yield done()
                row, chunk = r, _Chunk(r)
                at, high, low = chunk.grams(n)
                order, starts = _by_gram(high, low, chunk.line[at])
                spread, entry = np.diff(starts, append=len(order)), np.zeros(len(starts), bool)
                high = high[order[starts]]
                places = dict(_dealt(_turn(high).astype(np.int64) * parts + _part(high, parts)))
            else:
                own = places[r["n"]]
                entry[own] = np.unpackbits(np.frombuffer(r["live"], np.uint8), count=len(own)).astype(bool)
        if chunk is not None:
            yield done()

    return run


# ---------------------------------------------------------------- 3. paired

_WINDOWS = "part int, high binary, low binary, passage binary, line_no binary, back binary, size long, texts binary"


def _windows(n: int, width: int, parts: int, turn: int):
    """Marked grams of a pass, with their lines and windows; ``back`` says that the word before is in
    front of the window, as the gram that starts there is marked as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row)
            live = np.unpackbits(np.frombuffer(row["live"], np.uint8), count=len(chunk.ids)).astype(bool)
            live &= np.frombuffer(row["known"], np.uint8).astype(bool)[chunk.line]
            at, high, low = chunk.grams(n, turn)
            own = np.flatnonzero(live[at])
            if not len(own):
                continue
            at, high, low, line = at[own], high[own], low[own], chunk.line[at[own]]
            back = (at > 0) & live[at - 1] & (chunk.line[at - 1] == line)
            word_sizes = np.fromiter(map(len, chunk.vocabulary), np.int64, len(chunk.vocabulary))[chunk.ids] + 1
            starts = np.concatenate([[0], np.cumsum(word_sizes)])
            text = " ".join(map(chunk.vocabulary.__getitem__, chunk.ids.tolist()))
            first, last = starts[at - back].tolist(), (starts[np.minimum(at + width, chunk.end[at])] - 1).tolist()
            passage, line_no = np.frombuffer(row["passage"], np.int64)[line], np.frombuffer(row["line_no"], np.int32)[line]
            found = []
            for k, x in _dealt(_part(high, parts)):
                texts = "\n".join([text[first[i] : last[i]] for i in x.tolist()]).encode("utf-8", "surrogatepass")
                found.append((k, high[x].tobytes(), low[x].tobytes(), passage[x].tobytes(), line_no[x].tobytes(), back[x].astype(np.uint8).tobytes(), len(texts), pa.compress(texts, codec="zstd", asbytes=True)))
            yield _batch({"part": pa.array([x[0] for x in found], pa.int32())} | {name: [x[i] for x in found] for i, name in enumerate(["high", "low", "passage", "line_no", "back", "size", "texts"], 1)})

    return run


def _paired(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(_rows(batches))
        if not rows:
            return
        high, low, passage, line_no, back = (np.concatenate([np.frombuffer(r[name], kind) for r in rows]) for name, kind in (("high", np.uint64), ("low", np.uint32), ("passage", np.int64), ("line_no", np.int32), ("back", np.uint8)))
        texts = [t for r in rows for t in pa.decompress(r["texts"], r["size"], codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")]
        del rows
        order, starts = _by_gram(high, low, np.arange(len(high)))
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        cuts = [0]
        while cuts[-1] < len(order):  # whole groups only
            to = cuts[-1] + _AT_ONCE
            cuts.append(len(order) if to >= len(order) else int(starts[group[to]]) if starts[group[to]] > cuts[-1] else int(np.searchsorted(group, group[to], "right")))
        for at, to in zip(cuts, cuts[1:], strict=False):
            own = order[at:to]
            i, j, score = _alike(group[at:to], [texts[x] for x in own.tolist()], back[own].astype(bool), threshold)
            (pi, pj), (li, lj) = ((v[own[i]], v[own[j]]) for v in (passage, line_no))
            turned = (pi > pj) | (pi == pj) & (li > lj)
            pick = lambda x, y, turned=turned: np.where(turned, y, x)
            yield _batch({"passage_a": pick(pi, pj), "line_a": pick(li, lj), "passage_b": pick(pj, pi), "line_b": pick(lj, li), "score": score})

    return run


def _alike(group: np.ndarray, texts: list[str], back: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of entries of one group whose windows score the threshold, and their scores."""
    whole = np.asarray(pa.array(texts, pa.string()).dictionary_encode().indices)
    coded = pa.array([t.split(" ", 1)[1] if b else t for t, b in zip(texts, back.tolist(), strict=True)], pa.string()).dictionary_encode()
    window, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    same, other = [], []
    for d in range(1, len(group)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        j = i + d
        equal = window[i] == window[j]
        # alike one word before as well: told there
        told = equal & back[i] & back[j] & (whole[i] == whole[j])
        same.append((i[equal & ~told], j[equal & ~told]))
        a, b = sizes[window[i]], sizes[window[j]]
        ask = ~equal & (np.minimum(a, b) * 200.0 >= threshold * (a + b))
        other.append((i[ask], j[ask]))
    (i, j), (k, m) = ([np.concatenate([_EMPTY, *(x[end] for x in found)]) for end in (0, 1)] for found in (same, other))
    asked, which = np.unique(np.minimum(window[k], window[m]) * len(names) + np.maximum(window[k], window[m]), return_inverse=True)
    scores = np.zeros(len(asked))
    for at in range(0, len(asked), _AT_ONCE):
        scores[at : at + _AT_ONCE] = _scores(*([names[x] for x in end.tolist()] for end in np.divmod(asked[at : at + _AT_ONCE], len(names))))
    good = scores[which] >= threshold
    return np.concatenate([i, k[good]]), np.concatenate([j, m[good]]), np.concatenate([np.full(len(i), 100.0), scores[which][good]])


def _scores(a: list[str], b: list[str]) -> np.ndarray:
    """``ratios``; what two windows start with (their gram at least) is common and isn't searched again."""
    wide = max(map(len, a + b))
    left, right = (np.array(x, f"U{wide}").view(np.uint32).reshape(len(x), wide) for x in (a, b))
    apart = left != right
    shared = np.where(apart.any(axis=1), apart.argmax(axis=1), wide).tolist()
    rest = lcs_all([x[k:] for x, k in zip(a, shared, strict=True)], [x[k:] for x, k in zip(b, shared, strict=True)])
    return 200.0 * (rest + shared) / np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))


# ---------------------------------------------------------------- the plan


def scored_lines(parts: DataFrame, p: Params) -> DataFrame:
    """passage_a, line_a, passage_b, line_b (a before b), score: the best score of two lines' windows, if
    it is the threshold or more. Passages are whole numbers; unknown ones count, but pair with nothing."""
    spark = prepare(parts.sparkSession)
    parts = parts.select(F.col("passage").cast("long").alias("passage"), "lines")
    # rows that share a passage are one text, whose words stand side by side by line and place
    again = materialise(parts.groupBy("passage").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("passage").alias("again")), "pair-repeated")
    rows = parts.select("passage", F.lit(1).alias("first"), "lines")
    if again.limit(1).count():
        same = F.col("passage").eqNullSafe(F.col("again"))
        merged = words(parts.join(again, same, "left_semi")).groupBy("passage", "line_no").agg(F.sort_array(F.collect_list(F.struct("position", "word"))).alias("ws"))
        rows = rows.join(again, same, "left_anti").union(merged.select("passage", "line_no", F.array(F.transform("ws", lambda x: x["word"]))))
    chunks = materialise(rows.mapInArrow(_chunks(max(p.gram, p.gram - 1 + p.min_grams)), _CHUNK), "pair-chunks")
    size = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = at_least(spark, size // (PASSES * _PER_TASK) + 1)
    few = [
        materialise(
            chunks.mapInArrow(_counted(p.gram, tasks, turn), "part int, chunk long, high binary, low binary, lines binary").repartitionById(tasks, "part").mapInArrow(_few(p.stop_gram_df, tasks, turn), "chunk long, n long, live binary"),
            "pair-few",
        )
        for turn in range(PASSES)
    ]
    bits = reduce(DataFrame.union, few).select(F.lit(1).alias("role"), *(F.col(x) if x in ("chunk", "n", "live") else F.lit(None).cast(chunks.schema[x].dataType).alias(x) for x in _FIELDS))
    both = chunks.select(F.lit(0).alias("role"), *_FIELDS).union(bits)
    marked = materialise(both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "role").mapInArrow(_marked(p.gram, tasks), _CHUNK), "pair-marked")
    discard(chunks, *few)
    found = [
        materialise(
            marked.mapInArrow(_windows(p.gram, p.pair_window, tasks, turn), _WINDOWS).repartitionById(tasks, "part").mapInArrow(_paired(p.pair_threshold), _PAIR),
            "pair-scores",
        )
        for turn in range(PASSES)
    ]
    discard(marked)
    return reduce(DataFrame.union, found).groupBy("passage_a", "line_a", "passage_b", "line_b").agg(F.max("score").alias("score"))
