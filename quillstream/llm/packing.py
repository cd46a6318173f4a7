"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A document's ids and an end id are cut only if they exceed the sequence length. The
pieces are dealt evenly to groups of about ``GROUP`` pieces. Inside a group only lengths
matter, so its problem is a histogram with one entry a length at most, however many
pieces it has. Every group is worked on by several islands, one task each:

* a population starts from best-fit decreasing and from best-fit over perturbed orders;
* crossover injects well-filled bins of one parent into the other, drops the bins that
  would repeat pieces, and best-fits the displaced pieces, largest first;
* every epoch has at least one generation of crossovers; it ends early only where the
  island's fittest packing has reached the lower bound, which no packing can better;
* after the first epoch each island's elite migrates to the next island of its group and
  joins that island's own population for the second one (groups at their bound have no
  second epoch);
* the best elite of the group is its packing.

A group loses a part of one sequence at most against the bound of all pieces together, and
groups have thousands of sequences.

Defined cases: null text counts as empty and gives a piece that holds the end id alone;
repeated rows are packed as documents of their own, and so are rows with a null doc_id; an
empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import materialise, prepare
from .encoding import encoder

END = 0
LIMIT = 2048
GROUP = 1 << 15
ISLANDS = 3
POPULATION = 4
GENERATIONS = 6

Bin = tuple[int, ...]


def best_fit(lengths: list[int], limit: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Each length in turn goes to the fullest bin that holds it, or opens a bin. The
    bins by free space are a bit set, so a step doesn't depend on how many are open."""
    bins = bins if bins is not None else []
    by_free: dict[int, list[list[int]]] = {}
    mask = 0
    for b in bins:
        free = limit - sum(b)
        if free > 0:
            by_free.setdefault(free, []).append(b)
            mask |= 1 << free
    for x in lengths:
        fits = mask >> x
        if fits:
            free = x + (fits & -fits).bit_length() - 1
            held = by_free[free]
            b = held.pop()
            if not held:
                mask &= ~(1 << free)
        else:
            free, b = limit, []
            bins.append(b)
        b.append(x)
        free -= x
        if free:
            by_free.setdefault(free, []).append(b)
            mask |= 1 << free
    return bins


def lower_bound(counts: Counter, limit: int) -> int:
    """Martello and Toth's L2: for each k, lengths over limit - k need a bin each, lengths
    over half of it need another, and what these leave free takes lengths of k or more."""
    n = np.zeros(limit + 2, np.int64)
    for x, c in counts.items():
        n[x] += c
    size = n * np.arange(limit + 2)
    up, vol = np.cumsum(n[::-1])[::-1], np.cumsum(size[::-1])[::-1]
    half = limit // 2
    best = -(-int(vol[0]) // limit)
    for k in range(1, half + 1):
        large, middle = int(up[limit - k + 1]), int(up[half + 1] - up[limit - k + 1])
        free = middle * limit - int(vol[half + 1] - vol[limit - k + 1])
        small = int(vol[k] - vol[half + 1])
        best = max(best, large + middle + max(0, -(-(small - free) // limit)))
    return best


def crossover(a: list[Bin], b: list[Bin], limit: int, rng: random.Random) -> list[Bin]:
    """Well-filled bins of b go into a; a's bins that would use a piece twice go, and
    their other pieces are best-fitted into what stays."""
    ranked = sorted(b, key=sum, reverse=True)
    take = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]
    rng.shuffle(take)
    take = take[: max(1, len(take) * 3 // 4)]
    left = Counter(x for y in a for x in y)
    left.subtract(x for y in take for x in y)
    kept = []
    for y in sorted(a, key=sum, reverse=True):
        need = Counter(y)
        if sum(y) * 50 >= limit * 49 and all(left[x] >= c for x, c in need.items()):
            left.subtract(need)
            kept.append(list(y))
    displaced = sorted(left.elements(), reverse=True)
    return [tuple(x) for x in best_fit(displaced, limit, [*map(list, take), *kept])]


def fitness(bins: list[Bin], limit: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of how full they are."""
    return -len(bins), sum((sum(x) / limit) ** 2 for x in bins) / max(1, len(bins))


Packing = list[Bin]


def population(counts: Counter, limit: int, rng: random.Random) -> list[Packing]:
    """Best-fit decreasing and best-fit over perturbed orders."""
    down = sorted(counts.elements(), reverse=True)
    people = [[tuple(x) for x in best_fit(down, limit)]]
    while len(people) < POPULATION:
        order = sorted(down, key=lambda x: -x * rng.uniform(0.8, 1.25))
        people.append([tuple(x) for x in best_fit(order, limit)])
    return people


def evolve(counts: Counter, limit: int, seed: int, people: list[Packing], migrants: list[Packing]) -> list[Packing]:
    """An island's epoch: its population with the migrants, the fittest first. No population
    yet starts one."""
    bound, rng = lower_bound(counts, limit), random.Random(seed)
    rank = lambda found: sorted(found, key=lambda p: fitness(p, limit), reverse=True)[:POPULATION]
    people = rank([*(people or population(counts, limit, rng)), *migrants])
    for _ in range(GENERATIONS):
        children = [crossover(*rng.sample(people, 2), limit, rng) for _ in range(POPULATION)] if len(people) > 1 else []
        people = rank(people + children)
        if len(people[0]) <= bound:
            break
    return people


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], "<u4").tobytes()
        with encoder(path) as code:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    rows: list[tuple] = []
                    for doc, raw in zip(part.column("doc_id").to_pylist(), code.encode([x or "" for x in part.column("text").to_pylist()]), strict=True):
                        ids = np.frombuffer(raw, code.dtype).astype("<u4").tobytes() + end
                        for k, start in enumerate(range(0, len(ids), 4 * limit)):
                            piece = ids[start : start + 4 * limit]
                            rows.append((doc, k, start // 4, len(piece) // 4, zlib.crc32(piece)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _flat(bins: list[Bin]) -> tuple[list[int], list[int]]:
    return [len(b) for b in bins], [x for b in bins for x in b]


def _unflat(sizes, items) -> list[Bin]:
    out, at = [], 0
    items = [int(x) for x in items]
    for n in sizes:
        out.append(tuple(items[at : at + n]))
        at += n
    return out


#: An island's population, the fittest packing first.
_PEOPLE = "grp long, island int, solved boolean, sizes array<array<int>>, items array<array<int>>"


def _epoch(limit: int):
    """Rows with a histogram, the island's population and the elite that comes to it (both
    empty at first) -> the island's population after an epoch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                counts = Counter({int(x): int(n) for x, n in zip(row.lengths, row.counts, strict=True)})
                people = [_unflat(a, b) for a, b in zip(row.sizes, row.items, strict=True)]
                migrants = [_unflat(row.new_sizes, row.new_items)] if len(row.new_sizes) else []
                seed = int(row.grp) * 64 + int(row.island) * 8 + bool(people)
                people = evolve(counts, limit, seed, people, migrants)
                sizes, items = zip(*map(_flat, people), strict=True)
                yield pd.DataFrame({"grp": [row.grp], "island": [row.island], "solved": [len(people[0]) <= lower_bound(counts, limit)], "sizes": [list(sizes)], "items": [list(items)]})

    return run


def _place(limit: int):
    def run(key, pieces: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        bins = _unflat(elite.sizes.iloc[0], elite["items"].iloc[0]) if len(elite) else []
        slots: dict[int, list[tuple[int, int]]] = {}
        for i, b in enumerate(bins):
            at = 0
            for x in b:
                slots.setdefault(x, []).append((i, at))
                at += x
        pieces = pieces.sort_values(["length", "doc_id", "piece", "uid"], ignore_index=True)
        own, placed = len(bins), []
        for x in pieces.length:
            if x == limit:
                placed.append((own, 0))
                own += 1
            else:
                placed.append(slots[x].pop())
        pieces["sequence_id"] = [(int(key[0]) << 32) + i for i, _ in placed]
        pieces["offset"] = [at for _, at in placed]
        return pieces.drop(columns=["uid", "grp"])

    return run


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Texts are read once and never shuffled; pieces and histograms are narrow."""
    spark = prepare(docs.sparkSession)
    cut = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, limit), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialise(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    counts = pieces.filter(F.col("length") < limit).groupBy("grp", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one entry a length
    problem = counts.groupBy("grp").agg(F.collect_list(F.struct(F.col("length").cast("int").alias("l"), "n")).alias("h"))
    hist = materialise(problem.select("grp", F.col("h.l").alias("lengths"), F.col("h.n").alias("counts")).repartition(groups, "grp"), "histograms")
    none, nobody = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    islands = hist.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    dealt = lambda df: df.select("grp", "island", "lengths", "counts", "sizes", "items", "new_sizes", "new_items").repartition(groups * ISLANDS, "grp", "island")
    new = islands.select("*", nobody.alias("sizes"), nobody.alias("items"), none.alias("new_sizes"), none.alias("new_items"))
    first = materialise(dealt(new).mapInPandas(_epoch(limit), _PEOPLE), "islands")
    fewest = F.min_by(F.struct(F.col("sizes")[0].alias("sizes"), F.col("items")[0].alias("items")), F.struct(F.size(F.col("sizes")[0]), "island"))
    elites = lambda df: df.groupBy("grp").agg(fewest.alias("e")).select("grp", "e.sizes", "e.items")
    hard = first.groupBy("grp").agg(F.max("solved").alias("done")).filter("not done").select("grp")
    people = first.join(hard, "grp").drop("solved")
    moved = people.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("sizes")[0].alias("new_sizes"), F.col("items")[0].alias("new_items"))
    second = materialise(dealt(people.join(moved, ["grp", "island"]).join(hist, "grp")).mapInPandas(_epoch(limit), _PEOPLE), "islands")
    best = elites(first.join(hard, "grp", "left_anti").select("grp", "island", "sizes", "items").union(second.select("grp", "island", "sizes", "items")))
    placed = pieces.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(_place(limit), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed
