"""Where did sessions start? Detection against the distributed corpus, for batch and streams.

The windows of all sessions that are still unknown are queries of one search (``search.location``):
signatures and postings meet by joins, and no index is shipped to a task. A session locks on
its first window with a clear lead, or when a passage leads the recent votes; from then on it
has a reference, its window is replayed, and the rows go to a tracker.

On a stream each micro-batch does that for the sessions that are open: their rows are a table
that the batch replaces, and a session leaves it when it locks or ends.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.similarity import ratio
from ..operators import search
from ..operators.corpus import words
from ..params import DEFAULT, OPENINGS, Params
from ..sources.session import discard, discard_path, materialise, prepare, table_exists
from .scan import track_scan

_FORMULAS = [w for _, ws in OPENINGS for w in ws]


@F.pandas_udf(IntegerType())
def _said(first: pd.Series) -> pd.Series:
    """How many leading tokens are of the opening formulas, in their order."""

    def count(tokens: list[str]) -> int:
        left = _FORMULAS
        for n, token in enumerate(tokens):
            at = next((j for j, w in enumerate(left) if ratio(token, w) >= DEFAULT.match_score_min), None)
            if at is None:
                return n
            left = left[at + 1 :]
        return len(tokens)

    return first.map(lambda ts: count(list(ts)))


def heard(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """rows: session_id, seq, tokens -> session_id, seq, window (the last tokens up to that row, without
    the opening); rows with too little to go by have a null window."""
    each = rows.select("session_id", "seq", F.posexplode_outer("tokens").alias("k", "token"))
    order = Window.partitionBy("session_id").orderBy("seq", "k")
    first = rows.groupBy("session_id").agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.slice("tokens", 1, len(_FORMULAS)).alias("t")))), lambda x: x["t"])), 1, len(_FORMULAS)).alias("first"))
    begin = first.select("session_id", _said("first").alias("said"))
    counted = each.withColumn("i", F.count("token").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = counted.join(begin, "session_id").withColumn("token", F.when(F.col("i") > F.col("said"), F.col("token")))
    tail = F.collect_list("token").over(order.rowsBetween(-(p.detect_max_tokens + len(_FORMULAS)), 0))
    total = F.count("token").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = kept.withColumn("tail", F.slice(F.reverse(tail), 1, p.detect_max_tokens)).withColumn("total", total)
    ended = last.groupBy("session_id", "seq").agg(F.max_by(F.struct(F.reverse("tail").alias("tail"), "total"), F.coalesce("k", F.lit(-1))).alias("w"))
    return ended.select("session_id", "seq", F.when(F.col("w.total") >= p.detect_min_tokens, F.col("w.tail")).alias("window"))


def locks(rows: DataFrame, parts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """session_id, seq, passage, line_no, score, window: the row at which a session is located, if it is.
    ``parts``: the corpus (``corpus.passages``)."""
    prepare(rows.sparkSession)
    asked = materialise(heard(rows, p).filter("window is not null").withColumn("query", F.struct("session_id", "seq")), "windows")
    top = materialise(search.location(parts, asked.select("query", F.col("window").alias("tokens")), p), "window-hits")
    clear = search.margin(top, p).select("query", "passage", "line_no", "score", "locked")
    seen = clear.select("query.session_id", "query.seq", "passage", "line_no", "score", "locked")
    # the recent votes of weaker windows: a passage that leads by enough is taken at its best vote
    votes = seen.filter(~F.col("locked") & (F.col("score") >= p.vote_floor))
    recent = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1 - p.votes_kept, 0)
    listed = votes.withColumn("recent", F.collect_list(F.struct("passage", "line_no", "score")).over(recent))
    tally = F.transform(F.array_distinct(F.transform("recent", lambda v: v["passage"])), lambda q: F.struct(F.size(F.filter("recent", lambda v: v["passage"] == q)).alias("n"), q.alias("passage")))
    ranked = listed.withColumn("counts", F.reverse(F.array_sort(F.transform(tally, lambda t: t["n"])))).withColumn("tally", tally)
    ahead = (F.col("counts")[0] >= p.votes_needed) & (F.col("counts")[0] - F.coalesce(F.get("counts", F.lit(1)), F.lit(0)) >= p.votes_lead)
    leader = F.filter("tally", lambda t: t["n"] == F.col("counts")[0])[0]["passage"]
    best = F.aggregate(F.filter("recent", lambda v: v["passage"] == F.col("leader")), F.lit(None).cast("struct<passage:bigint,line_no:int,score:double>"), lambda a, v: F.when(a.isNull() | (v["score"] > a["score"]), v).otherwise(a))
    voted = ranked.filter(ahead).withColumn("leader", leader).withColumn("best", best).select("session_id", "seq", "best.passage", "best.line_no", "best.score")
    found = seen.filter("locked").drop("locked").union(voted)
    first = found.groupBy("session_id").agg(F.min("seq").alias("seq"), F.min_by(F.struct("passage", "line_no", "score"), "seq").alias("at"))
    located = first.select("session_id", "seq", "at.*")
    return located.join(asked.select("session_id", "seq", "window"), ["session_id", "seq"])


def references(located: DataFrame, parts: DataFrame) -> DataFrame:
    """session_id, reference: for each located session the words from its line to the passage's end, as
    a tracker's ``open`` row has them. Words and lines are numbered within their passage."""
    wanted = located.select("session_id", "passage", F.col("line_no").alias("from_line"))
    each = words(parts).join(wanted, "passage").filter(F.col("line_no") >= F.col("from_line"))
    quoted = F.regexp_extract(F.to_json(F.array("word")), r"^\[(.*)\]$", 1)
    entry = F.concat(F.lit("["), F.concat_ws(",", (F.col("pos") + 1).cast("string"), F.col("passage").cast("string"), *[F.col(c).cast("string") for c in ("line_no", "line_no", "position")], quoted), F.lit("]"))
    listed = each.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("es"))
    return listed.select("session_id", F.concat(F.lit("["), F.concat_ws(",", F.transform("es", lambda x: x["e"])), F.lit("]")).alias("reference"))


def tracked(rows: DataFrame, located: DataFrame, parts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Events of located sessions from their lock on: the window is replayed in the row that locked,
    and later rows follow. rows: session_id, seq, tokens. Sessions without a lock have no events."""
    body = F.concat(F.lit('{"opening": false, "reference": '), "reference", F.lit("}"))
    opened = located.join(references(located, parts), "session_id").select("session_id", (F.col("seq") * 2 - 1).alias("seq"), F.lit("open").alias("kind"), body.alias("body"))
    tokens = lambda c: F.to_json(F.struct(F.col(c).alias("tokens")))
    replayed = located.select("session_id", (F.col("seq") * 2).alias("seq"), F.lit("tokens").alias("kind"), tokens("window").alias("body"))
    later = rows.join(located.select("session_id", F.col("seq").alias("at")), "session_id").filter("seq > at").select("session_id", (F.col("seq") * 2).alias("seq"), F.lit("tokens").alias("kind"), tokens("tokens").alias("body"))
    events = track_scan(opened.union(replayed).union(later).withColumn("seq", F.col("seq").cast("int")), p)
    return events.withColumn("seq", (F.col("seq") / 2).cast("int"))


class OnStream:
    """``foreachBatch`` handler: locates the sessions of a stream of rows (session_id, seq, tokens).

    Under ``folder`` each micro-batch leaves the rows of the sessions that are still open, which the next
    one reads, and what locked in it. A batch that is run again replaces its own folders, so nothing is
    lost or told twice; the tables of the batch before the last are deleted."""

    def __init__(self, parts: DataFrame, folder: str, p: Params = DEFAULT):
        self.parts, self.folder, self.p = parts, folder.rstrip("/"), p

    def _table(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def __call__(self, fresh: DataFrame, batch: int) -> None:
        spark = prepare(fresh.sparkSession)
        rows = fresh.select("session_id", "seq", "tokens")
        known = self._table("open", batch - 1)
        if table_exists(spark, known):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(known))
        # a session that has locked is no longer looked for
        if table_exists(spark, f"{self.folder}/locks"):
            done = spark.read.parquet(f"{self.folder}/locks").filter(F.col("batch") < batch)
            rows = rows.join(done.select("session_id"), "session_id", "left_anti")
        rows = materialise(rows, "open-rows")
        found = locks(rows, self.parts, self.p)
        found.write.mode("overwrite").parquet(self._table("locks", batch))
        now = spark.read.schema(found.schema).parquet(self._table("locks", batch))
        rows.join(now.select("session_id"), "session_id", "left_anti").write.mode("overwrite").parquet(self._table("open", batch))
        discard_path(spark, self._table("open", batch - 2))
        discard(rows)
