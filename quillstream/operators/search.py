"""Where does a passage of tokens come from? Exact, fuzzy and id-vote searches.

Each is an equi-join of query grams or words with postings and an aggregation by diagonal.
Queries are many rows, not one: all of them are answered by the same plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import floor_div
from ..params import DEFAULT, Params
from ..sources.session import materialise, prepare
from .corpus import entries, runs, stream_grams, words
from .fuzzy import nearest_words


def _top(df: DataFrame, k: int) -> DataFrame:
    """The k best per query: score, then the query's first index, passage and place."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "first_index", "passage", "anchor")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Distinct grams of the queries that are held by every task.
MOST_GRAMS = 1 << 20
#: Distinct words that a task counts before it hands them on.
MOST_WORDS = 1 << 19


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """passage, lines -> word, n, and its first passage (null before all) and place, of a task's rows."""
    counts: Counter = Counter()
    first: dict[str, tuple] = {}

    def emit() -> pa.RecordBatch:
        known = [*first]
        places = [first[w] for w in known]
        columns = [pa.array(known, pa.string()), pa.array([counts[w] for w in known], pa.int64()), pa.array([k for _, k, _ in places], pa.int64(), mask=np.array([not named for named, _, _ in places], bool)), pa.array([at for _, _, at in places], pa.int64())]
        counts.clear()
        first.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "first_passage", "first_pos"])

    for batch in batches:
        for k, lines in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ws = pc.list_flatten(lines.values).to_pylist() if lines.is_valid else []
            counts.update(ws)
            for w, at in dict(zip(reversed(ws), range(len(ws) - 1, -1, -1), strict=True)).items():
                place = (k is not None, k or 0, at)
                if w not in first or place < first[w]:
                    first[w] = place
            if len(first) > MOST_WORDS:
                yield emit()
    yield emit()


def vocabulary_of(parts: DataFrame) -> DataFrame:
    """word, n, first_passage, first_pos: counted inside tasks, so that a row for each different word
    of a task is sorted and shuffled, not one for each word."""
    prepare(parts.sparkSession)
    some = parts.select("passage", "lines").mapInArrow(_counted, "word string, n long, first_passage long, first_pos long")
    found = some.groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct("first_passage", "first_pos")).alias("f"))
    return found.select("word", "n", "f.first_passage", "f.first_pos")


def _asked_grams(queries: DataFrame, column: str, n: int) -> DataFrame:
    """query, i, gram, n: the grams of each query, with how many it has."""
    q = runs(entries(queries, "query", column, "token"), ["query"], "i", "token", n)
    return q.select("query", "i", "gram", F.count(F.lit(1)).over(Window.partitionBy("query")).alias("n"))


def _matching(rows: DataFrame, key: str, lines: Column, grams: DataFrame, n: int) -> DataFrame | None:
    """key, line_no, pos, gram: runs of n words (of ``lines``, arrays of words) that are asked
    for. One pass over each row: what no query asks for never leaves the task. None if the
    grams are too many to be held by a task."""
    held = [r.gram for r in grams.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    if len(held) > MOST_GRAMS:
        return None
    found = prepare(rows.sparkSession).sparkContext.broadcast(frozenset(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(found.value, n)
        for batch in batches:
            row, line, pos, grams = asked.places(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)).cast(pa.int64()), pa.array(line, pa.int32()), pa.array(pos, pa.int64()), pa.array(grams, pa.string())], [key, "line_no", "pos", "gram"])

    return rows.select(key, lines.alias("lines")).mapInArrow(run, f"{key} long, line_no int, pos long, gram string")


class Asked:
    """Grams of n words that are asked for. Words are numbered by Arrow and runs of numbers are
    hashed as arrays, so only runs that are asked for become strings."""

    def __init__(self, grams: frozenset, n: int):
        self.grams, self.n = grams, n
        parts = [g.split(" ") if n > 1 else [g] for g in grams]
        self.words = pa.array(sorted({w for ws in parts for w in ws}), pa.string())
        parts = [ws for ws in parts if len(ws) == n]
        codes = pc.index_in(pa.array([w for ws in parts for w in ws], pa.string()), self.words).to_numpy(zero_copy_only=False)
        self.hashes = np.unique(self._hashed(codes.astype(np.int64).reshape(-1, n).T))

    def _hashed(self, codes) -> np.ndarray:
        h = np.zeros(len(codes[0]), np.uint64)
        for c in codes:
            h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def places(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Row, line (from 1), place in the row, gram of the runs in rows of lines of words; runs
        may cross lines."""
        n, none = self.n, np.empty(0, np.int64)
        lines = pc.list_flatten(rows)
        words = pc.list_flatten(lines)
        if len(words) < n or not self.grams:
            return none, none, none, []
        sizes = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        line_row = np.repeat(np.arange(len(rows)), sizes(rows))
        word_line = np.repeat(np.arange(len(lines)), sizes(lines))
        runs = len(words) - n + 1
        codes = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False)
        may = codes >= 0
        if n > 1:  # a word that holds blanks is no part of a gram as it is split
            may |= pc.fill_null(pc.match_substring(words, " "), False).to_numpy(zero_copy_only=False)
        can = may[:runs].copy()
        for j in range(1, n):
            can &= may[j : j + runs]
        at = np.flatnonzero(can)
        at = at[line_row[word_line[at]] == line_row[word_line[at + n - 1]]]
        if len(self.hashes):
            h = self._hashed([codes[at + j].astype(np.int64) for j in range(n)])
            hit = self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h
        else:
            hit = np.zeros(len(at), bool)
        if n > 1:
            hit |= np.logical_or.reduce([codes[at + j] < 0 for j in range(n)])
        at = at[hit]
        grams = list(map(" ".join, zip(*(words.take(pa.array(at + j)).to_pylist() for j in range(n)), strict=True)))
        good = np.fromiter((g in self.grams for g in grams), bool, len(grams))
        at, grams = at[good], [g for g, ok in zip(grams, good, strict=True) if ok]
        line = word_line[at]
        row = line_row[line]
        first_line, first_word = np.searchsorted(line_row, row), np.searchsorted(line_row[word_line], row)
        return row, line - first_line + 1, at - first_word, grams


def relocation(parts: DataFrame, queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """queries: query, tokens. Exact n-gram diagonals: query, rank, passage, line_no, anchor,
    matched, score. Matches in one fixed bucket of diagonals form a run; its score is its
    matches per query gram, its anchor the first matched position."""
    q = _asked_grams(queries, "tokens", p.gram)
    places = _matching(parts, "passage", F.col("lines"), q, p.gram)
    hits = (stream_grams(parts, p.gram) if places is None else places).join(q, "gram")
    run = hits.groupBy("query", "passage", floor_div(F.col("pos") - F.col("i"), p.diagonal_width).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("matched"), F.min("pos").alias("anchor"), F.min("line_no").alias("line_no"), F.min("i").alias("first_index"), F.first("n").alias("n")
    )
    top = _top(run.withColumn("score", F.col("matched") / F.col("n")), p.top_hits)
    return top.select("query", "rank", "passage", "line_no", "anchor", "matched", "score")


def corrections(vocabulary: DataFrame, wanted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """token -> the most similar vocabulary word of at least the cutoff; the one that comes
    first in the corpus on ties. Only tokens that aren't words themselves are looked up."""
    unknown = wanted.select("token").distinct().join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    return nearest_words(materialise(unknown, "unknown"), vocabulary, p.match_score_min, ("first_passage", "first_pos"))


def _postings_of(parts: DataFrame, postings: DataFrame, looked_up: DataFrame) -> DataFrame:
    """passage, line_no, pos, word of the words that are looked up, found in one pass over each
    passage; all postings if these are more words than a task should hold."""
    found = _matching(parts, "passage", F.col("lines"), looked_up.select(F.col("word").alias("gram")), 1)
    return postings if found is None else found.withColumnRenamed("gram", "word")


def location(parts: DataFrame, queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Noise-tolerant search by single words: unknown tokens are corrected to the nearest
    vocabulary word first, words with too many postings are skipped, and a run's score is the
    share of query tokens on its diagonal. Runs of one token don't count."""
    postings = words(parts).select("passage", "pos", "line_no", "word")
    vocabulary = materialise(vocabulary_of(parts), "vocabulary")
    asked = entries(queries, "query", "tokens", "token").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("query")))
    fixed = corrections(vocabulary, asked, p)
    fixed = materialise(fixed, "corrections")
    known = asked.join(fixed.select("token", F.col("word").alias("fix")), "token", "left").withColumn("word", F.coalesce("fix", "token"))
    usable = vocabulary.filter(F.col("n") <= p.common_word_postings).select("word")
    looked_up = known.join(usable, "word", "left_semi").select("query", "size", "i", "word")
    hits = _postings_of(parts, postings, looked_up).join(looked_up, "word")
    run = hits.groupBy("query", "passage", floor_div(F.col("pos") - F.col("i"), p.diagonal_width).alias("diagonal")).agg(
        F.count_distinct("i").alias("matched"), F.min("pos").alias("anchor"), F.min("line_no").alias("line_no"), F.min("i").alias("first_index"), F.first("size").alias("size")
    )
    scored = run.filter(F.col("matched") >= p.min_run).withColumn("score", F.col("matched") / F.col("size"))
    return _top(scored, p.top_hits).select("query", "rank", "passage", "line_no", "anchor", "matched", "score")


def id_votes(sequences: DataFrame, queries: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """sequences: item, ids; queries: query, ids. Each query gram votes once for every
    sequence that has it; score = votes per query gram; the smaller item wins ties."""
    q = _asked_grams(queries, "ids", p.id_gram).select("query", "gram", "n")
    places = _matching(sequences, "item", F.array(F.col("ids").cast("array<string>")), q, p.id_gram)
    has = runs(entries(sequences, "item", "ids", "id"), ["item"], "i", "id", p.id_gram) if places is None else places
    votes = has.select("item", "gram").distinct().join(q, "gram").groupBy("query", "item").agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
    w = Window.partitionBy("query").orderBy((F.col("votes") / F.col("n")).desc(), "item")
    return votes.select("query", "item", "votes", (F.col("votes") / F.col("n")).alias("score"), F.row_number().over(w).alias("rank")).filter(F.col("rank") <= p.top_hits)


def margin(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per query its top hit and the lead over the best hit at another place: other passage,
    or over two lines away."""
    hits = materialise(hits, "hits")  # read twice
    top = hits.filter("rank = 1").select("query", F.col("passage").alias("p1"), F.col("line_no").alias("l1"), F.col("score").alias("s1"))
    other = hits.join(top, "query").filter((F.col("passage") != F.col("p1")) | (F.abs(F.col("line_no") - F.col("l1")) > 2))
    second = other.groupBy("query").agg(F.max("score").alias("s2"))
    lead = F.col("s1") - F.coalesce("s2", F.lit(0.0))
    locked = (F.col("s1") >= p.detect_score_min) & (F.col("s2").isNull() | (lead >= p.detect_margin))
    return top.join(second, "query", "left").select("query", F.col("p1").alias("passage"), F.col("l1").alias("line_no"), F.col("s1").alias("score"), lead.alias("lead"), locked.alias("locked"))


