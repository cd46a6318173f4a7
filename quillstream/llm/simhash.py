"""SimHash near-duplicate groups by anchor-point covering.

A document's fingerprint has 64 bits: bit i is set if it is set in over half of the
XXH64 hashes of its word shingles. Two fingerprints link at ``threshold`` or fewer
differing bits; a group is a connected component of those links.

Anchors are the words of a covering code. Each fingerprint is cut into two halves of 32
bits; of two fingerprints with at most t differing bits, one half differs in at most
t // 2 of them. A half is covered by the perfect Hamming code [31, 26] (covering radius 1)
times its last bit: some code word lies within 1 of it. So fingerprints that agree up
to s bits in a half share every anchor within 1 of either, and both are replicated to
all anchors within 1 + s of their half. For thresholds of 2 and 3, s is 1 and that makes
at most 17 anchors a half (a code on all 64 bits would need over 650 for radius 1).
Fingerprints are then compared per anchor, on all 64 bits.

Equal fingerprints are collapsed before anything is replicated, so groups of copies of
any size cost one row. In an anchor only a spanning forest of the links leaves the
task: never all pairs. Anchors with more than ``CROWD`` fingerprints are dealt again by
thirds of the other half: with at most 2 (or 3) bits in which they differ spread over
t + 1 blocks, one block is equal, so replicas of each block value meet again and no link
is lost. Inside a crowd still too large for comparisons in blocks, the words within the
threshold are looked up in the sorted fingerprints, which is linear in the crowd.

Defined cases: null text counts as empty; documents without words have fingerprint 0
and link like any other; fewer words than a shingle give one shingle of the whole
sequence; repeated rows each give a row; rows with a null doc_id keep a fingerprint and
take the smallest doc_id of their group (null if it has none); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import at_least, materialise, prepare
from .components import components, local_stars

SEED = 42
#: Fingerprints at an anchor beyond which it is dealt again.
CROWD = 4096
#: Replicas that a task gets, about.
ANCHORED = 8_000_000


def lower_words(text: str | None) -> list[str]:
    """Words in lower case; both steps on bytes, where they know ASCII only."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b"\n".join(parts).decode("utf-8", "surrogatepass").split("\n") if parts else []


def shingles(words: list[str], k: int) -> list[str]:
    if len(words) < k:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash; 0 without words. Counts run over the whole text."""
    return int(majority([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), SEED) for x in shingles(lower_words(text), k)]))


def majority(hashes: list[int] | np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return np.uint64(0)
    raw, sums = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        sums += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(sums * 2 > len(hashes), bitorder="little").view("<u8")[0]


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array([fingerprint(x.as_py(), k) for x in part.column("text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Of the low 31 bits under the Hamming code whose column i is i + 1; 0: a code word."""
    s = np.zeros(v.shape, np.int64)
    for bit in range(31):
        s ^= np.where((v >> bit) & 1, bit + 1, 0)
    return s


def _flips(s: int) -> list[int]:
    """Masks of up to s bits of 32."""
    return [sum(1 << b for b in c) for n in range(s + 1) for c in combinations(range(32), n)]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): all code words within 1 + threshold // 2 of each half.

    A word within that distance arises by flipping up to that many bits and keeping
    what then has syndrome 0; syndromes are linear, so this is one xor a mask."""
    rows, out = [], []
    masks = np.array(_flips(1 + threshold // 2), dtype=np.int64)
    of_masks = _syndrome(masks)
    for side in (0, 1):
        half = ((fps >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        i, j = np.nonzero(_syndrome(half)[:, None] == of_masks[None, :])
        rows.append(i)
        out.append((half[i] ^ masks[j]) | (side << 32))
    return np.concatenate(rows), np.concatenate(out)


def _to_anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                row, key = anchors(fps.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["anchor", "fp"])

    return run


def forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links among distinct signed fingerprints."""
    n, us, vs = len(fps), [], []
    x = fps.view(np.uint64)
    if n <= CROWD:
        for at in range(0, n, 512):
            near = np.bitwise_count(x[at : at + 512, None] ^ x[None, :]) <= threshold
            i, j = np.nonzero(near)
            up = i + at < j
            u, v = local_stars(fps[i[up] + at], fps[j[up]])
            us.append(u)
            vs.append(v)
    else:
        x = np.sort(x)
        for bits in range(1, threshold + 1):
            for c in combinations(range(64), bits):
                y = x ^ np.uint64(sum(1 << b for b in c))
                at = np.minimum(np.searchsorted(x, y), n - 1)
                hit = (x[at] == y) & (x < y)
                if hit.any():
                    us.append(x[hit].view(np.int64))
                    vs.append(y[hit].view(np.int64))
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return local_stars(np.concatenate(us), np.concatenate(vs))


def _per_anchor(threshold: int):
    """Rows sorted by anchor -> links of each anchor; an anchor may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest = None, []
        us, vs = [], []

        def close(fps: np.ndarray) -> None:
            if len(fps) > 1:
                u, v = forest(np.unique(fps), threshold)
                us.append(u)
                vs.append(v)

        def pairs(a: np.ndarray, b: np.ndarray) -> None:
            """Anchors with two fingerprints are most of those that matter: all at once."""
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= threshold) & (a != b)
            us.append(np.maximum(a, b)[near])
            vs.append(np.minimum(a, b)[near])

        for batch in batches:
            ks, fps = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            cuts = np.flatnonzero(np.diff(ks)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ks)]])
            if len(ks) and ks[0] != key and rest:
                close(np.concatenate(rest))
                rest = []
            if len(starts) == 1:
                rest.append(fps)
                key = ks[0]
                continue
            close(np.concatenate([*rest, fps[: ends[0]]]))
            key, rest = ks[-1], [fps[starts[-1] :]]
            a, b = starts[1:-1], ends[1:-1]
            two = a[b - a == 2]
            pairs(fps[two], fps[two + 1])
            for s, e in zip(a[b - a > 2], b[b - a > 2], strict=True):
                close(fps[s:e])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us.clear()
                vs.clear()
        if rest:
            close(np.concatenate(rest))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _deal_again(threshold: int):
    """Anchors of crowds, by blocks of the other half: one of threshold + 1 is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = threshold + 1
        cut = [32 * i // n for i in range(n + 1)]
        for batch in batches:
            key, fps = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            other = np.where(key >> 32, fps & 0xFFFFFFFF, (fps >> 32) & 0xFFFFFFFF)
            for i in range(n):
                block = (other >> cut[i]) & ((1 << (cut[i + 1] - cut[i])) - 1)
                h = (key * 0x9E3779B1 + i) * 0x1000003 + block
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(fps)], ["anchor", "fp"])

    return run


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct long fingerprints ``fp`` -> (u, v): per anchor a spanning forest of the
    pairs within ``threshold``; together these have the components of all such pairs."""
    # at most 34 anchors a fingerprint for thresholds of 2 and 3
    n = at_least(fps.sparkSession, fps.count() * 34 // ANCHORED + 1)
    keyed = fps.mapInArrow(_to_anchors(threshold), "anchor long, fp long")
    sizes = keyed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("anchor")
    crowds = materialise(sizes, "crowds")
    if crowds.limit(1).count():
        plain = keyed.join(crowds, "anchor", "left_anti")
        dealt = keyed.join(crowds, "anchor", "left_semi").mapInArrow(_deal_again(threshold), "anchor long, fp long")
        keyed = plain.union(dealt)
    return keyed.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_per_anchor(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fp long, component_id (the smallest doc_id reachable, itself included)."""
    prepare(docs.sparkSession)
    marked = materialise(docs.select("doc_id", "text").mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fp"), threshold))
    root = classes.join(found, classes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialise(root.join(least, "root").select("fp", "component_id"), "class-components")
    return marked.join(by_class, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = 3, threshold: int = 2) -> DataFrame:
    """The documents whose doc_id is the smallest of their group, with all their columns.
    Rows with a null doc_id can't be named by a group and pass."""
    heads = near_duplicates(docs, k, threshold).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(heads, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))
