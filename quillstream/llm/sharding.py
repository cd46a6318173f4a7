"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 64-bit hashes. A key belongs to the
first point at or clockwise after its own hash. Shard capacities add up to exactly the
number of rows and differ by one at most, so the law ``rows`` holds. Keys are served in
ring order, starting at the ring's origin; a key whose shard is full continues
clockwise to the next point whose shard has room, and wraps around at the end.

Serving key by key would be sequential. Rows that share an arc (the gap before a point)
meet the same shards in the same order, so only the number of rows of each arc matters:
one small aggregation (shards x vnodes rows, whatever the input) reaches the driver,
which settles how many rows of each arc go to which shard. Rows then find their place
by their rank within the arc. Nothing but built-in functions touches the rows.

Defined cases: a null key hashes like any other value; rows that repeat a key are rows of
their own (and spread over the ring where their texts differ; wholly equal rows take
neighbouring slots and can be exchanged); null text has size 8 and the crc of the empty string;
an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VNODES = 128


def _unit(x: int) -> int:
    """A 64-bit mix of x (the finaliser of splitmix64), as a signed long."""
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(hash, shard) of all points, ascending by hash."""
    return sorted((_unit(s * 1_000_003 + zlib.crc32(b"%d/%d" % (s, v))), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    Arcs are served in ring order. ``nxt`` links a point to the next one that may have
    room, with path compression, so the whole walk is nearly linear in the points.
    """
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    n, out = len(points), []
    nxt = list(range(n))

    def open_from(i: int) -> int:
        seen = []
        while True:
            i %= n
            if nxt[i] != i:
                seen.append(i)
                i = nxt[i]
            elif room[points[i][1]] == 0:
                seen.append(i)
                nxt[i] = i = (i + 1) % n
            else:
                break
        for j in seen:
            nxt[j] = i
        return i

    for arc in range(n):
        rank, left = 0, counts.get(arc, 0)
        at = arc
        while left:
            at = open_from(at)
            shard = points[at][1]
            took = min(left, room[shard])
            out.append((arc, rank, rank + took, shard, used[shard]))
            room[shard] -= took
            used[shard] += took
            rank += took
            left -= took
    return out


def _arc(h: Column, points: list[tuple[int, int]]) -> Column:
    """The number of points below h, modulo their count: a binary search that is
    unrolled over the top bits of the hash and finished inside a slice."""
    hashes = [p for p, _ in points]
    bits = max(0, (len(points) - 1).bit_length())
    size = 1 << bits
    step = 1 << (64 - bits)
    low = -(1 << 63)
    cells, starts = [], []
    for c in range(size):
        a = bisect.bisect_left(hashes, low + c * step)
        b = bisect.bisect_left(hashes, low + (c + 1) * step)
        starts.append(a)
        cells.append(hashes[a:b])
    cell = (F.shiftright(h, 64 - bits) + F.lit(size // 2)).cast("int") if bits else F.lit(0)
    table = F.from_json(F.lit(json.dumps(cells)), "array<array<bigint>>")
    first = F.from_json(F.lit(json.dumps(starts)), "array<int>")
    inside = F.aggregate(F.get(table, cell), F.lit(0), lambda n, p: n + (p < h).cast("int"))
    return F.pmod(F.get(first, cell) + inside, F.lit(len(points)))


def ring_shards(df: DataFrame, key: str, shards: int, vnodes: int = VNODES, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long; equal counts within one row.

    Rows are hashed by ``key`` and ``ties``: columns that tell rows of a repeated key apart, so
    that they spread over the ring and their order within an arc doesn't depend on the task
    that sorts them. One aggregation over these columns, one window over narrow arcs. Columns of
    ``df`` keep their names; only ``shard`` and ``slot`` are replaced if they exist.
    """
    spark = df.sparkSession
    points = ring(shards, vnodes)
    taken = {*df.columns}
    name = lambda x: next(y for y in (x + "_" * i for i in range(len(taken) + 2)) if y not in taken)
    arc, hashed, rank = name("__arc"), name("__hash"), name("__rank")
    by = [F.col(f"`{c}`") for c in (key, *ties)]
    located = df.withColumn(hashed, F.xxhash64(*by)).withColumn(arc, _arc(F.col(f"`{hashed}`"), points))
    # at most shards x vnodes rows, whatever the input
    counts = {r[0]: r[1] for r in located.groupBy(arc).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = settle(points, counts, shards)
    rows = json.dumps([{"a": a, "f": f, "e": e, "s": s, "b": b} for a, f, e, s, b in plan])
    lit = F.from_json(F.lit(rows), "array<struct<a:int,f:bigint,e:bigint,s:int,b:bigint>>")
    ranges = spark.range(1).select(F.inline(lit))
    w = Window.partitionBy(arc).orderBy(hashed, *by)
    ranked = located.withColumn(rank, F.row_number().over(w).cast("long") - 1)
    parts = ranges.groupBy(F.col("a").alias("a")).agg(F.sort_array(F.collect_list(F.struct("f", "e", "s", "b"))).alias("p"))
    # one row per arc at most: bounded by the ring, not by the data
    joined = ranked.join(F.broadcast(parts), F.col(f"`{arc}`") == F.col("a"))
    hit = F.get(F.filter("p", lambda x: (x["f"] <= F.col(rank)) & (F.col(rank) < x["e"])), F.lit(0))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    return joined.withColumn("p", hit).select(*keep, F.col("p.s").alias("shard"), (F.col("p.b") + F.col(rank) - F.col("p.f")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    placed = ring_shards(narrow, "doc_id", shards, vnodes, ("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
