"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of as many words as the item slide over a document.
Places of the document that hold a shingle of the item (5 words in lower case, without
punctuation), wherever it stands in the item, are counted for every window; the count bounds
the similarity from above, so all windows that can reach ``SIMILAR`` are tried, the
largest bound first, until no bound exceeds the best similarity found. A window and an item
each have a SimHash of 64 bits over their shingles. Fingerprints are looked up in a multi-index of 8 blocks of 8 bits: of two fingerprints with at most ``RADIUS`` = 23
differing bits, some block differs in at most 23 // 8 = 2, so tables that list, for each
block value, the items within 2 bits guarantee every fingerprint within the radius. (Shingle
similarities of 0.8 differ in 10 bits on average, by 3 at one standard deviation; a similar
window beyond the radius is lost, which is estimated at one in a million.) What
the index returns is verified: the exact similarity is the weight that window and item
share over the weight of both, a shingle weighing as often as it occurs. 0.8 or more is a hit.

The benchmark is read in blocks of ``BLOCK`` characters; each is small by construction
and broadcast by itself, so a benchmark of any size is checked against all documents.
Documents are not shuffled.

Defined cases: null document text counts as empty; items whose text is null or has no word match
nothing; an item of fewer than 5 words is one shingle of all its words; repeated
benchmark rows are one item, repeated documents each count; a null id stays null; an empty table on either side gives no hit.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import prepare

WORDS, SIMILAR, RADIUS, BITS = 5, 0.8, 23, 8
#: Characters of the benchmark that are broadcast at once.
BLOCK = 4 << 20
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str]) -> list[str]:
    k = min(WORDS, len(words))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


def _signs(shingles: list[str]) -> np.ndarray:
    raw = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in shingles], "<u8")
    return np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1, bitorder="little").view("<u8").reshape(sums.shape[:-1])


class Index:
    """Items with their shingles, fingerprints and, by size in words, the multi-index."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.bags = [Counter(shingles_of(w)) for _, w in self.items]
        self.vocabulary: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        #: shingle size -> hash -> items that hold such a shingle
        self.holders: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for n, (_, w) in enumerate(self.items):
            k = min(WORDS, len(w))
            ids = np.array([self.vocabulary[x] for x in w], np.int64)
            for h in np.unique(self.rolled(ids, k)).tolist():
                self.holders[k][h].append(n)
            self.by_size[len(w)].append(n)
        self.holders = {k: dict(v) for k, v in self.holders.items()}
        self.by_size = dict(self.by_size)
        #: item -> its place among those of its size
        self.column = {n: c for own in self.by_size.values() for c, n in enumerate(own)}
        self.known = {k: np.sort(np.array(list(v), np.uint64)) for k, v in self.holders.items()}
        self.prints = np.array([_pack(_signs(shingles_of(w)).sum(0)[None])[0] for _, w in self.items], np.uint64)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BITS
        #: item size -> for each block, block value x items of that size: within reach?
        self.reach = {size: [near[:, ((self.prints[own] >> np.uint64(8 * b)) & np.uint64(255)).astype(int)] for b in range(BITS)] for size, own in self.by_size.items()}

    @staticmethod
    def rolled(ids: np.ndarray, k: int) -> np.ndarray:
        """A hash of each k neighbouring word ids."""
        h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (h ^ (ids[j : len(ids) - k + 1 + j].astype(np.uint64) + np.uint64(1))) * _P
                h ^= h >> np.uint64(31)
        return h

    def windows(self, words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Item -> (first words, bounds) of the windows that can be similar enough, largest
        bound first: a window shares at most as many shingles as it has places that hold
        one of the item's, wherever in the item that stands."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, known in self.known.items():
            if len(ids) < k:
                continue
            lack = np.concatenate([[0], np.cumsum(ids < 0)])
            full = np.flatnonzero(lack[k:] == lack[:-k])
            if not len(full):
                continue
            h = self.rolled(ids, k)[full]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            found: dict[int, list[int]] = defaultdict(list)
            for p, x in zip(full[known[at] == h].tolist(), h[known[at] == h].tolist(), strict=True):
                for n in self.holders[k][x]:
                    found[n].append(p)
            for n, places in found.items():
                size = len(self.items[n][1])
                own, there = size - k + 1, min(size, len(words)) - k + 1
                # both / (own + there - both) >= SIMILAR
                least = (own + there) * SIMILAR / (1 + SIMILAR) - 1e-9
                if len(places) < least:
                    continue
                p = np.array(places)
                starts = np.arange(max(0, int(p[0]) - there + 1), min(int(p[-1]), len(words) - min(size, len(words))) + 1)
                shared = np.searchsorted(p, starts + there) - np.searchsorted(p, starts)
                can = shared >= least
                if can.any():
                    starts, shared = starts[can], shared[can]
                    order = np.lexsort((starts, -shared))
                    out[n] = starts[order], (shared / (own + there - shared))[order]
        return out

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, differing bits, first word) of each item's best window."""
        words = words_of(text)
        best: dict[int, tuple[int, float, int, int]] = {}
        for n, (starts, bounds) in self.windows(words).items():
            size = len(self.items[n][1])
            for start, bound in zip(starts.tolist(), bounds.tolist(), strict=True):
                if n in best and bound < best[n][1] - 1e-9:
                    break
                window = shingles_of(words[start : start + size])
                fp = _pack(_signs(window).sum(0)[None])[0]
                # the item's column in the tables of its size
                if not any(self.reach[size][b][int(fp >> np.uint64(8 * b)) & 255, self.column[n]] for b in range(BITS)):
                    continue
                bits = int(np.bitwise_count(self.prints[n] ^ fp))
                if bits > RADIUS:
                    continue
                s = similarity(Counter(window), self.bags[n])
                if s >= SIMILAR and (n not in best or (-s, start) < (-best[n][1], best[n][3])):
                    best[n] = (self.items[n][0], s, bits, start)
        return [best[n] for n in sorted(best)]


_OUT = "doc_id long, item_id long, similarity double, differing_bits int, first_word long"


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, *h) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for h in index.value.hits(text.as_py())]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "differing_bits", "first_word"])

    return run


def _blocks(benchmark: DataFrame, block: int) -> Iterator[Index]:
    """The benchmark, a bounded share at a time."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    total = texts.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    n = -(-int(total) // block)
    for k in range(n):
        rows = texts.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Index([tuple(r) for r in rows])


def contaminations(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per document and item that it holds: similarity, bits and place of the best
    window."""
    spark = prepare(docs.sparkSession)
    parts = [docs.select("doc_id", "text").mapInArrow(_scan(spark.sparkContext.broadcast(i)), _OUT) for i in _blocks(benchmark, block)]
    if not parts:
        return spark.createDataFrame([], _OUT)
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _clean(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not index.value.hits(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, with all their columns; one pass a block."""
    spark = prepare(docs.sparkSession)
    for i in _blocks(benchmark, block):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(i), docs.columns.index("text")), docs.schema)
    return docs
