"""The reference corpus: passages made of ordered lines made of ordered words.

Words are numbered inside their passage's row, so stream positions need no window. Runs of
neighbours are windows over exploded words: arrays of runs would have to be built in
lambdas, which the optimiser inlines down to the text and evaluates once an element.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_non_empty, tokens
from ..sources.session import materialise, prepare


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: str = "letters") -> DataFrame:
    """passage, lines: array<array<string>>; empty lines keep their number."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: tokens(x, profile))
    return docs.select(F.col(id_col).alias("passage"), lines.alias("lines"))


def words(parts: DataFrame) -> DataFrame:
    """passage, pos (from 0 over the passage), line_no and position (from 1), word."""
    entry = F.flatten(F.transform("lines", lambda line, i: F.transform(line, lambda w, j: F.struct((i + 1).alias("line_no"), (j + 1).alias("position"), w.alias("word")))))
    # the outer form infers no filter that would tokenise the text again
    rows = parts.select("passage", F.posexplode_outer(entry).alias("pos", "e")).filter("e is not null")
    return rows.select("passage", "pos", "e.line_no", "e.position", "e.word")


def entries(df: DataFrame, key: str, array: str, item: str) -> DataFrame:
    """key, i (from 0), item: an array's elements as rows."""
    return df.select(key, F.posexplode_outer(array).alias("i", item)).filter("i is not null")


#: Neighbours that one task of a window gets at most, of one key.
STRETCH = 1 << 16


def runs(rows: DataFrame, by: list[str], order: str, item: str, n: int, out: str = "gram", stretch: int = 0) -> DataFrame:
    """``rows`` with the run of n neighbours that starts there; rows without one go. ``order``
    counts the rows of a key without gaps, so a key is cut into stretches of known borders: the
    first n - 1 rows of a stretch are copied to the one before, and a key with any share of all
    rows is spread over many tasks."""
    size = stretch or STRETCH
    own = F.floor(F.col(order) / size)
    borrowed = (F.col(order) % size < n - 1) & (own > 0)
    spread = rows.withColumn("__stretch", F.explode(F.when(borrowed, F.array(own, own - 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*by, "__stretch").orderBy(order)
    ahead: list[Column] = [F.col(item).cast("string"), *(F.lead(F.col(item).cast("string"), k).over(w) for k in range(1, n))]
    found = spread.withColumn(out, F.when(ahead[-1].isNotNull(), F.concat_ws(" ", *ahead)))
    return found.filter(F.col(out).isNotNull() & (F.col("__stretch") == own)).drop("__stretch")


def stream_grams(parts: DataFrame, n: int) -> DataFrame:
    """passage, pos, line_no, gram: runs of n words that may cross lines."""
    return runs(words(parts), ["passage"], "pos", "word", n).select("passage", "pos", "line_no", "gram")


def line_grams(parts: DataFrame, n: int, width: int) -> DataFrame:
    """passage, line_no, gram, ahead (the ``width`` words from its first place in the line),
    grams (how many runs the line has)."""
    line = Window.partitionBy("passage", "line_no")
    ahead = F.concat_ws(" ", F.collect_list("word").over(line.orderBy("position").rowsBetween(0, width - 1)))
    rows = words(parts).withColumn("ahead", ahead).withColumn("grams", F.count(F.lit(1)).over(line) - (n - 1))
    found = runs(rows, ["passage", "line_no"], "position", "word", n)
    first = F.min_by(F.struct("ahead", "grams"), "position").alias("f")
    return found.groupBy("passage", "line_no", "gram").agg(first).select("passage", "line_no", "gram", "f.ahead", "f.grams")


def line_sums(parts: DataFrame) -> DataFrame:
    """passage, line_no, n_words, first_pos, least, longest of lines that have words, by rows of lines:
    the least word of exploded words is an aggregate that sorts all of them."""
    start = F.aggregate("lines", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x))))
    rows = parts.select("passage", F.posexplode_outer(F.arrays_zip(F.col("lines").alias("ws"), F.slice(start, 1, F.greatest(F.size("lines"), F.lit(0))).alias("first_pos"))).alias("i", "e"))
    ws = F.col("e.ws")
    longest = F.aggregate(ws, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))
    sums = rows.filter(F.size(ws) > 0).select("passage", (F.col("i") + 1).alias("line_no"), F.size(ws).cast("long").alias("n_words"), F.col("e.first_pos").cast("long").alias("first_pos"), F.array_min(ws).alias("least"), longest.cast("long").alias("longest"))
    return sums.groupBy("passage", "line_no").agg(F.sum("n_words").alias("n_words"), F.min("first_pos").alias("first_pos"), F.min("least").alias("least"), F.max("longest").alias("longest"))


def _sets(n: int, named: bool):
    """passage, lines -> the different runs of n words of each line, with its name if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lines = pc.list_flatten(part.column(1))
                words = pc.list_flatten(lines).to_pylist()
                grams, sizes, end = [], [], 0
                for size in pc.list_value_length(lines).to_pylist():
                    own = words[end : end + size]
                    found = set(map(" ".join, zip(*(own[j:] for j in range(n)), strict=False)))
                    grams += found
                    sizes.append(len(found))
                    end += size
                if not named:
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string())], ["gram"])
                    continue
                numbers = [i + 1 for k in pc.list_value_length(part.column(1)).to_pylist() for i in range(k or 0)]
                keys = part.column(0).take(pc.list_parent_indices(part.column(1))).to_pylist()
                spread = [(k, i) for k, i, s in zip(keys, numbers, sizes, strict=True) for _ in range(s)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in spread], pa.int64()), pa.array([i for _, i in spread], pa.int32()), pa.array(grams, pa.string())], ["passage", "line_no", "gram"])

    return run


def line_gram_counts(parts: DataFrame, n: int) -> DataFrame:
    """gram, df: in how many lines each run of n words is. A line's runs are made inside its row, so
    only runs are shuffled, and no name with them. Rows that share a passage count a run of one
    line number once; these rows alone go through names."""
    prepare(parts.sparkSession)
    again = materialise(parts.groupBy("passage").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("passage").alias("again")), "repeated-passages")
    rows, shared = parts.select("passage", "lines"), None
    if again.limit(1).count():
        same = F.col("passage").eqNullSafe(F.col("again"))
        shared = rows.join(again, same, "left_semi").mapInArrow(_sets(n, True), "passage long, line_no int, gram string").distinct().select("gram")
        rows = rows.join(again, same, "left_anti")
    grams = rows.mapInArrow(_sets(n, False), "gram string")
    return (grams if shared is None else grams.union(shared)).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def reference_from(words_df: DataFrame, lines_df: DataFrame, passage: int, from_line: int) -> DataFrame:
    """The ordered reference of a session: words of one passage from a line on, with a
    global index from 0 (inner join of words and lines, range filter, sequence index)."""
    chosen = lines_df.filter((F.col("surah_id") == passage) & (F.col("number") >= from_line)).select(F.col("id").alias("ayah_id"), F.col("surah_id").alias("surah"), F.col("number").alias("ayah"))
    joined = words_df.join(F.broadcast(chosen), "ayah_id")  # lines of one passage
    w = Window.partitionBy("surah").orderBy("ayah", "position")
    return joined.select((F.row_number().over(w) - 1).alias("idx"), F.col("id").alias("word_id"), "surah", "ayah", "ayah_id", "position", F.col("text_normalized").alias("norm"))


def nested_text(words_df: DataFrame, lines_df: DataFrame) -> DataFrame:
    """Lines with their words nested in order."""
    return words_df.join(lines_df.select(F.col("id").alias("ayah_id"), "surah_id", "number"), "ayah_id").groupBy("surah_id", "number", "ayah_id").agg(F.sort_array(F.collect_list(F.struct("position", F.col("id").alias("word_id"), F.col("text_uthmani").alias("text")))).alias("words"))


def flatten_verses(pages: DataFrame) -> DataFrame:
    """Landed JSON pages (verses[].words[]) -> word rows: verses exploded, non-words dropped,
    positions counted after that, the display form falling back on the other one."""
    verse = pages.select(F.explode("verses").alias("v")).select("v.id", "v.verse_key", "v.words")
    kept = verse.select("id", "verse_key", F.filter("words", lambda w: w["char_type_name"] == "word").alias("ws"))
    rows = kept.select("id", "verse_key", F.posexplode("ws").alias("i", "w"))
    return rows.select(
        F.col("w.id").alias("id"), F.col("id").cast("int").alias("ayah_id"), (F.col("i") + 1).alias("position"),
        F.col("w.text_uthmani").alias("text_uthmani"), first_non_empty(F.col("w.text_imlaei"), F.col("w.text_uthmani")).alias("text_imlaei"),
        F.array_join(tokens(first_non_empty(F.col("w.text_imlaei"), F.col("w.text_uthmani")), "arabic"), " ").alias("text_normalized"),
    )
