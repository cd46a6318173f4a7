"""Near copies: SimHash groups them first, an exact self-join over word shingles links the rest.

Two documents link if the Jaccard similarity of their sets of shingles (5 words in lower
case) is 0.8 or more; a group is a connected component of those links. No link is lost:
of n shingles in any order that is the same for all documents, the first
n - ceil(0.8 n) + 1 hold a shingle of every document that is similar enough. (Fingerprints
alone can't give that at a radius an anchor code can cover: at similarity 0.8 they differ in
10 of 64 bits on average, by 3 at one standard deviation.)

The order puts shingles that are frequent in a sample of the documents last, so that
boilerplate seldom brings documents together; the sample decides the order only, never
which links are found. Documents with equal sets are collapsed first. Documents that share
a shingle of their prefixes form a bucket. Of small buckets all pairs whose sizes allow the
similarity are verified: first on parities of their sets, which bound the difference from
below, then on the whole sets, as far as their ends aren't in one component yet. Of large ones neighbours are verified first, in
order of size and then in a random order; last, all pairs whose ends are still in different
components. So a large group of near copies costs a few pairs a document.

Defined cases: null text counts as empty; documents without words are equal to each other and
similar to no other; fewer words than a shingle give one shingle of the whole sequence;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import discard, materialise, partitions, prepare
from . import simhash
from .components import components

WORDS = 5
#: Bits in which fingerprints of the first groups differ at most.
RADIUS = 2
#: Buckets up to this size have all their pairs verified at once.
SMALL = 32
#: One in so many documents is sampled for the order; a shingle counts as frequent from
#: LEAST sampled documents on; of those the MOST most frequent are broadcast.
SAMPLED, LEAST, MOST = 16, 4, 1 << 19
#: Parities of a set, of which pairs are compared first: so many, or as many as the set
#: has members, rounded up to a power of two.
BITS = 1024
#: Pairs that a task hands on at once.
PAIRS = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : len(h) + j]) * _P
        h ^= h >> np.uint64(31)
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sets of hashes 0.8 or more? Whole numbers only."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles: by hash, but frequent ones last, by rank."""
    n = len(shingles)
    size = n - (4 * n + 4) // 5 + 1 if n else 0
    if not len(frequent):
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    known = frequent[at] == shingles
    rare = shingles[~known]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, shingles[known][np.argsort(rank[at[known]])][: size - len(rare)]])


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(x.as_py()) for x in batch.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])


def _key(shingles: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """Bit i: is the count of hashes equal to i modulo the number of bits odd? Of two sets the
    bits differ in at most as many places as the sets do."""
    bits = max(BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Places in which two parity vectors differ, the longer one folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [shingle_set(x.as_py()) for x in part.column("text")]
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            cols = [pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(parities, sets), pa.binary()), pa.array(fps)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *cols], ["doc_id", "t", "key", "n", "bits", "fp"])


def _explode(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = order.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = {_key(s): s for s in (shingle_set(x.as_py()) for x in batch.column(0).slice(at, 512))}
                firsts = [prefix(s, frequent, rank) for s in sets.values()]
                sizes = [len(x) for x in firsts]
                keys, n = np.repeat(np.array(list(sets), np.int64), sizes), np.repeat(np.array([len(s) for s in sets.values()], np.int32), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(keys), pa.array(n)], ["token", "key", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by their first column -> the same in chunks that end where it changes."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now, strict=True))
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield tuple(x[:cut] for x in now)
        rest = tuple(x[cut:] for x in now)
    if rest is not None:
        yield rest


def _bounds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(ids)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])


def _batch(a: np.ndarray, b: np.ndarray, members: list[bytes] | None = None) -> pa.RecordBatch:
    """Distinct pairs, the smaller key first; with ``members``, buckets behind them."""
    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.empty((0, 2), np.int64)
    u, v = pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))
    if members is None:
        return pa.RecordBatch.from_arrays([u, v], ["u", "v"])
    none = pa.nulls(len(members), pa.int64())
    cols = [pa.concat_arrays([u, none]), pa.concat_arrays([v, none]), pa.concat_arrays([pa.nulls(len(both), pa.binary()), pa.array(members, pa.binary())])]
    return pa.RecordBatch.from_arrays(cols, ["u", "v", "members"])


def _neighbours(keys: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one and two places apart, as far as their sizes allow."""
    a = np.concatenate([order[:-1], order[:-2]])
    b = np.concatenate([order[1:], order[2:]])
    can = 5 * np.minimum(n[a], n[b]).astype(np.int64) >= 4 * np.maximum(n[a], n[b]).astype(np.int64)
    return keys[a[can]], keys[b[can]]


def _first_pairs(small: int):
    """Rows by token -> pairs of small buckets and neighbours in large ones, and the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for tokens, keys, n in _runs(batches):
            # documents with equal sets meet here as one
            new = np.concatenate([[True], (np.diff(tokens) != 0) | (np.diff(keys) != 0)])
            tokens, keys, n = tokens[new], keys[new], n[new]
            s, e = _bounds(tokens)
            length = e - s
            us, vs, members = [], [], []
            for m in np.unique(length[(length > 1) & (length <= small)]).tolist():
                i, j = np.triu_indices(m, 1)
                first = s[length == m][:, None]
                a, b = (first + i).ravel(), (first + j).ravel()
                can = 5 * np.minimum(n[a], n[b]).astype(np.int64) >= 4 * np.maximum(n[a], n[b]).astype(np.int64)
                us.append(keys[a[can]])
                vs.append(keys[b[can]])
            for x, y in zip(s[length > small].tolist(), e[length > small].tolist(), strict=True):
                order = np.lexsort((keys[x:y], n[x:y]))
                raw = np.column_stack([keys[x:y], n[x:y].astype(np.int64)])[order].tobytes()
                mark = xxhash.xxh128_digest(raw)
                if mark in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(mark)
                a, b = _neighbours(keys[x:y], n[x:y], order)
                us.append(a)
                vs.append(b)
                members.append(raw)
            if us:
                yield _batch(np.concatenate(us), np.concatenate(vs), members)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("members"), strict=True):
            rows = np.frombuffer(raw.as_py(), np.int64).reshape(-1, 2)
            cols = [np.full(len(rows), bucket), rows[:, 0].copy(), rows[:, 1].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "key", "n"])


def _folded(bits: np.ndarray) -> np.ndarray:
    """Parity vectors, as rows of BITS bits each."""
    out = np.empty((len(bits), BITS // 64), np.uint64)
    for i, raw in enumerate(bits):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64))
    return out


def _across(whole: bool):
    """Rows bucket, key, n, component, parities by bucket -> pairs over the borders of components:
    neighbours in a random order or, as a ``whole``, all that sizes and parities allow. What
    the parities rule out never leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, all_keys, all_n, all_parts, all_bits in _runs(batches):
            for s, e in zip(*(x.tolist() for x in _bounds(buckets)), strict=True):
                keys, n, parts = all_keys[s:e], all_n[s:e].astype(np.int64), all_parts[s:e]
                if (parts == parts[0]).all():
                    continue
                odd = _folded(all_bits[s:e])
                may = lambda a, b, n=n, odd=odd: 9 * np.bitwise_count(odd[a] ^ odd[b]).sum(-1, dtype=np.int64) <= n[a] + n[b]
                by = (keys.view(np.uint64) * _P) >> np.uint64(20)
                if not whole:
                    # one of each component beside members of all others
                    order = np.argsort(by)
                    a, b = _neighbours(np.arange(e - s), n, order)
                    cross = (parts[a] != parts[b]) & may(a, b)
                    yield _batch(keys[a[cross]], keys[b[cross]])
                    continue
                order = np.lexsort((keys, n))
                keys, n, parts, odd = keys[order], n[order], parts[order], odd[order]
                top = np.searchsorted(n, 5 * n // 4, side="right")
                us, vs, held = [], [], 0
                for i in range(e - s):
                    js = np.arange(i + 1, top[i])
                    js = js[parts[js] != parts[i]]
                    js = js[9 * np.bitwise_count(odd[js] ^ odd[i]).sum(1, dtype=np.int64) <= n[js] + n[i]]
                    us.append(np.full(len(js), keys[i]))
                    vs.append(keys[js])
                    held += len(js)
                    if held > PAIRS:
                        yield _batch(np.concatenate(us), np.concatenate(vs))
                        us, vs, held = [], [], 0
                if held:
                    yield _batch(np.concatenate(us), np.concatenate(vs))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sets = [shingle_set(x.as_py()) for x in batch.column(0).slice(at, 512)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities allow the similarity: sets of it differ in (n + m) / 9 at most."""
    for batch in batches:
        if batch.num_rows:
            differ = np.array([differing(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)])
            both = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            yield batch.select(["u", "v"]).filter(pa.array(9 * differ <= both))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _whole(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, on their whole sets."""
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    return materialise(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_verify, "u long, v long"), "near-links")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links with the components of all pairs that link: by their parities first, then on the
    whole sets. Of these each document's pair with its least partner comes first; the others
    are compared only where their ends aren't in one component by then."""
    left, right = (classes.select(F.col("key").alias(k), F.col("n").alias(f"n{c}"), F.col("bits").alias(c)) for k, c in (("u", "a"), ("v", "b")))
    some = materialise(pairs.join(left, "u").join(right, "v").select("u", "v", "na", "nb", "a", "b").mapInArrow(_possible, "u long, v long"), "near-pairs")
    wanted = some.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    # as a table of known size: where it is small, texts aren't shuffled
    rows = materialise(classes.join(wanted, "key", "left_semi").select(F.col("any.doc_id").alias("a_doc"), F.col("any.t").alias("a_t")), "near-wanted")
    held = texts.join(rows, (texts.t == rows.a_t) & texts.doc_id.eqNullSafe(rows.a_doc), "left_semi").select("text")
    sets = materialise(held.mapInArrow(_sets, "key long, shingles binary").dropDuplicates(["key"]), "near-sets")
    both = some.select("u", "v").union(some.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("v"))
    first = materialise(least.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-first")
    links = _whole(first, sets)
    parts = components(links)
    left = some.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).join(first, ["u", "v"], "left_anti")
    rest = materialise(_apart(left, parts), "near-rest")
    out = materialise(links.union(_whole(rest, sets)), "near-links")
    discard(some, rows, sets, first, rest, links)
    return out


def _order(texts: DataFrame):
    """Broadcast (frequent shingles, sorted; their ranks, the most frequent last)."""
    sc = texts.sparkSession.sparkContext
    some = texts.filter(F.pmod("t", F.lit(SAMPLED)) == 0).select("text").mapInArrow(_all_shingles, "shingle long")
    found = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "shingle").limit(MOST).toArrow()
    shingles, n = found.column("shingle").to_numpy().astype(np.int64).view(np.uint64), found.column("n").to_numpy().astype(np.int64)
    by_hash = np.argsort(shingles)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((shingles, n))] = np.arange(len(n))
    return sc.broadcast((shingles[by_hash], rank[by_hash]))


def _close(classes: DataFrame) -> DataFrame:
    """Pairs u, v of documents whose fingerprints are equal or linked within ``RADIUS`` bits: of each
    fingerprint all with its least, and the least ones of a forest over the anchors."""
    heads = materialise(classes.groupBy("fp").agg(F.min("key").alias("head")), "near-heads")
    same = classes.join(heads, "fp").filter("key <> head").select(F.col("head").alias("u"), F.col("key").alias("v"))
    of = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}"))
    near = simhash.links(heads.select("fp"), RADIUS).distinct().join(of("u"), "u").join(of("v"), "v")
    out = materialise(same.union(near.select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))), "near-close")
    discard(heads)
    return out


def _apart(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    of = lambda k: grouped.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), and ``first``: doc_id and t of the group's document
    with the smallest doc_id, null last."""
    prepare(docs.sparkSession)
    parts = partitions(docs)
    texts = docs.select("doc_id", "text", _text_hash().alias("t"))
    marked = materialise(texts.mapInArrow(_mark, "doc_id long, t long, key long, n int, bits binary, fp long"), "near-marked")
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t")
    classes = materialise(marked.groupBy("key").agg(F.min(named).alias("least"), F.min(F.struct("doc_id", "t")).alias("any"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "near-classes")
    close = _close(classes)
    links = _verified(close, classes, texts)
    grouped = components(links)
    tokens = texts.select("text").mapInArrow(_explode(_order(texts)), "token long, key long, n int")
    found = materialise(tokens.repartition(parts, "token").sortWithinPartitions("token", "key").mapInArrow(_first_pairs(SMALL), "u long, v long, members binary").distinct(), "near-buckets")
    large = materialise(found.filter("members is not null").select(F.xxhash64("members").alias("bucket"), "members").mapInArrow(_members, "bucket long, key long, n int"), "near-large")
    links = links.union(_verified(_apart(found.filter("u is not null").select("u", "v"), grouped), classes, texts))
    grouped = components(links)
    if large.limit(1).count():
        for whole in (False, True):
            known = large.join(grouped.withColumnRenamed("node", "key"), "key", "left").join(classes.select("key", "bits"), "key").select("bucket", "key", "n", F.coalesce("component", "key").alias("part"), "bits")
            more = materialise(known.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_across(whole), "u long, v long").distinct(), "near-across")
            if more.limit(1).count():
                links = links.union(_verified(more, classes, texts))
                grouped = components(links)
    root = classes.join(grouped, classes.key == grouped.node, "left").select("key", F.coalesce("component", "key").alias("root"), "least")
    least = root.groupBy("root").agg(F.min("least").alias("first"))
    of_key = materialise(root.join(least, "root").select("key", "first"), "near-groups")
    discard(classes, close, found, large)
    return marked.select("doc_id", "t", "key").join(of_key, "key").select("doc_id", "t", "first")


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest doc_id, null
    last; on ties any one whose text has the smallest hash. Rows that share a doc_id but not
    their group are kept or dropped each by itself."""
    name = "__text_hash"
    while name in docs.columns:
        name += "_"
    rows = near_copies(docs).groupBy("doc_id", "t", "first").agg(F.count(F.lit(1)).alias("n"))
    heads = rows.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")))
    heads = heads.select(F.col("doc_id").alias("h_doc"), F.col("t").alias("h_t"), F.col("n").alias("h_n"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn(name, F.xxhash64(F.coalesce("row.text", F.lit(""))))
    stay = marked.join(heads, (F.col(name) == F.col("h_t")) & F.col("row.doc_id").eqNullSafe(F.col("h_doc")))
    # only rows that are repeated as they are meet once more
    once = stay.filter("h_n = 1").union(stay.filter("h_n > 1").dropDuplicates(["h_doc", "h_t"]))
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
