"""Session tables: event log, summaries, folds, upserts, retention and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, percent
from ..params import DEFAULT, Params
from ..schemas import TYPES
from ..sources.session import materialise

ERRORS = ("MISSED_WORD", "MISSED_AYAH", "MUTASHABEH_JUMP")


def persisted(events: DataFrame) -> DataFrame:
    """What the log keeps: events, but neither positions nor notices to the client."""
    return events.filter(F.col("type").isin(*(x for x in TYPES if x != "POSITION")))


def _count(kind: str, state: str) -> Column:
    return F.count_if((F.col("type") == kind) & (F.col("state") == state))


def summary_live(events: DataFrame) -> DataFrame:
    """Counts per session; a revocation takes its confirmed verdict back (revocation join)."""
    gone = events.filter("state = 'revoked'").select("session_id", F.col("refers_to").alias("event_id")).distinct()
    stands = events.filter("state = 'confirmed'").join(gone, ["session_id", "event_id"], "left_anti")
    return _counts(stands)


def summary_offline(events: DataFrame) -> DataFrame:
    """Counts per session of every confirmed row, revoked later or not."""
    return _counts(events.filter("state = 'confirmed'"))


def _counts(confirmed: DataFrame) -> DataFrame:
    ids = F.sort_array(F.collect_list(F.when(F.col("type").isin(*ERRORS), F.col("event_id"))))
    return confirmed.groupBy("session_id").agg(
        _count("WORD_OK", "confirmed").alias("words_ok"), _count("MISSED_WORD", "confirmed").alias("words_missed"),
        _count("MISSED_AYAH", "confirmed").alias("ayahs_missed"), _count("MUTASHABEH_JUMP", "confirmed").alias("jumps"),
        F.array_join(ids.cast("array<string>"), ",").alias("errors"),
    )


def summary_lines(events: DataFrame) -> DataFrame:
    """Sessions tracked by lines: no word is ever called missed."""
    return _counts(events.filter("state = 'confirmed'")).withColumn("words_missed", F.lit(0).cast("bigint")).withColumn("mode", F.lit("phoneme"))


def accuracy(summary: DataFrame) -> DataFrame:
    """Whole-percent accuracy, its colour band, and what kind of session it was."""
    pct = percent("words_ok", "words_missed")
    heard = (F.col("words_ok") + F.col("words_missed")) > 0
    issues = (F.col("words_missed") + F.col("ayahs_missed") + F.col("jumps")) > 0
    return summary.select("session_id", pct.alias("accuracy"), F.when(pct >= 90, "good").when(pct >= 70, "fair").otherwise("poor").alias("band"), F.when(~heard, "empty").when(issues, "issues").otherwise("clean").alias("kind"))


def final_state(events: DataFrame) -> DataFrame:
    """session_id, idx, status: what a client shows of each word after all events. A word's
    last deciding event wins: heard, missed (confirmed or not), or cleared by a revocation of
    a miss. A repetition clears provisional misses strictly after it."""
    e = events.filter("idx is not null")
    # repetitions reach all later places of their session, so they are compared, not joined by place
    deciding = e.filter("type in ('WORD_OK', 'MISSED_WORD')")
    w = Window.partitionBy("session_id", "idx").orderBy("event_id")
    status = F.when(F.col("type") == "WORD_OK", "ok").when(F.col("state") == "provisional", "missed-provisional").when(F.col("state") == "confirmed", "missed")
    seen = deciding.withColumn("status", status).withColumn("before", F.last("status", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # a revocation only clears a miss
    kept = seen.filter(F.col("status").isNotNull() | F.coalesce(F.col("before") != "ok", F.lit(True)))
    last = kept.groupBy("session_id", "idx").agg(F.max_by(F.struct("status", "event_id"), "event_id").alias("s")).select("session_id", "idx", "s.status", F.col("s.event_id").alias("at"))
    # the latest repetition behind each word, if any, cleared what was only provisional by then
    back = e.filter("type = 'REPEAT'").select("session_id", F.col("idx").alias("place"), F.col("event_id").alias("at"), F.lit(None).cast("string").alias("status"), F.lit(0).alias("word"))
    rows = last.select("session_id", F.col("idx").alias("place"), "at", "status", F.lit(1).alias("word")).union(back.select("session_id", "place", "at", "status", "word"))
    sofar = Window.partitionBy("session_id").orderBy("place", F.col("word").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.max(F.when(F.col("word") == 0, F.col("at"))).over(sofar)
    out = rows.withColumn("cleared", cleared).filter("word = 1 and status is not null")
    return out.filter(~((F.col("status") == "missed-provisional") & F.coalesce(F.col("cleared") > F.col("at"), F.lit(False)))).select("session_id", F.col("place").alias("idx"), "status")


def final_lines(events: DataFrame) -> DataFrame:
    """session_id, ayah, state: lines that a client shows as missed after all events. The last
    verdict on a line wins, and a revocation takes the line off the list."""
    last = events.filter("type = 'MISSED_AYAH'").groupBy("session_id", "ayah").agg(F.max_by("state", "event_id").alias("state"))
    return last.filter("state <> 'revoked'")


def final_jump(events: DataFrame) -> DataFrame:
    """session_id, event_id, state: the jump that a client shows after all events. The last one
    wins; only a later revocation that refers to this very event takes it off."""
    jumps = events.filter("type = 'MUTASHABEH_JUMP'")
    shown = jumps.filter("state <> 'revoked'").groupBy("session_id").agg(F.max_by(F.struct("event_id", "state"), "event_id").alias("j")).select("session_id", "j.event_id", "j.state")
    off = jumps.filter("state = 'revoked'").select("session_id", F.col("refers_to").alias("event_id"), F.col("event_id").alias("at"))
    gone = shown.join(off, ["session_id", "event_id"]).filter(F.col("at") > F.col("event_id"))
    return shown.join(gone, ["session_id", "event_id"], "left_anti")


def progress(states: DataFrame, sizes: DataFrame) -> DataFrame:
    """sizes: session_id, size of each line: session_id, total words, and words shown as heard."""
    total = sizes.groupBy("session_id").agg(F.sum("size").alias("total"))
    heard = states.groupBy("session_id").agg(F.count_if(F.col("status") == "ok").alias("heard"))
    return total.join(heard, "session_id", "left").select("session_id", "total", F.coalesce("heard", F.lit(0).cast("bigint")).alias("heard"))


def resume_points(events: DataFrame) -> DataFrame:
    """One past the last word heard."""
    return events.filter("type = 'WORD_OK' and state = 'confirmed'").groupBy("session_id").agg((F.max("idx") + 1).alias("resume_at"))


def by_type_and_state(events: DataFrame) -> DataFrame:
    return events.groupBy("type", "state").agg(F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merge by key: new rows replace old ones; columns a new row leaves null keep the old
    value."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def update_latest(rows: DataFrame, changes: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Point update: the latest change of each key sets ``column``."""
    last = changes.groupBy(key).agg(F.max_by(column, order).alias("__new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def purge(rows: DataFrame, owners: DataFrame, key: str, ts: str, now: Column, p: Params = DEFAULT) -> DataFrame:
    """What stays after retention: rows of other owners, and rows young enough."""
    old = F.col(ts) < now - F.expr(f"INTERVAL '{p.retention_days}' DAY")
    return rows.join(owners.select(key).distinct(), key, "left_anti").unionByName(rows.join(owners.select(key).distinct(), key, "left_semi").filter(~old))


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumable build still has to do."""
    return wanted.join(done.select(key), key, "left_anti")


def _running(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``value`` over the rows of the same keys up to that one.

    Few keys would make few tasks of a window over them. Rows are dealt by ranges of (keys,
    order) instead and added up inside each range; what lies before a range is a sum over
    one row a range and key, whose number doesn't follow the data."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = materialise(rows.repartitionByRange(parts, *by, order).withColumn("__part", F.spark_partition_id()), "running")
    totals = dealt.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("__inside", inside).join(base, [*by, "__part"]).withColumn("upto", F.col("__inside") + F.col("__base")).drop("__part", "__inside", "__base")


def nearest_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 95th percentile by index (floor(n / 2), floor(0.95 n)), never interpolated.
    Equal values are counted first; ranks are running sums of these counts."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy(*by).agg(F.sum("__n").alias("n"))
    ranked = _running(counts, by, value, "__n").join(F.broadcast(sizes), by)  # one row a key
    at = lambda q: F.floor(F.col("n") * F.lit(q))
    pick = lambda q: F.max(F.when((F.col("upto") - F.col("__n") <= at(q)) & (at(q) < F.col("upto")), F.col(value)))
    return ranked.groupBy(*by).agg(pick(0.5).alias("median"), pick(0.95).alias("p95"), F.max("n").alias("n"))


def real_time_factor(rows: DataFrame, by: str, took: str, duration: str, quality: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(took).alias("took"), F.sum(duration).alias("duration"), (F.sum(took) / F.sum(duration)).alias("rtf"), F.avg(quality).alias("quality"))


def gate(transcripts: DataFrame) -> DataFrame:
    """text, no_speech_prob, avg_logprob, compression_ratio, seconds -> gated. Fixed values."""
    bad = (F.col("no_speech_prob") > 0.6) | (F.col("avg_logprob") < -1.0) | (F.col("compression_ratio") > 2.4) | (F.col("seconds") < 0.4)
    return transcripts.withColumn("gated", F.coalesce(bad, F.lit(True)) | (F.coalesce("text", F.lit("")) == ""))


def without_phrases(transcripts: DataFrame, blocked: list[str]) -> DataFrame:
    """Transcripts whose matching form isn't one of the blocked phrases."""
    return transcripts.filter(~F.coalesce(F.col("normal"), F.lit("")).isin(blocked))


def confidence(segments: DataFrame, by: str) -> DataFrame:
    """Of a transcript's segments: worst no-speech and compression, mean log probability (-10
    without any), and the joined text."""
    return segments.groupBy(by).agg(F.coalesce(F.max("no_speech_prob"), F.lit(0.0)).alias("no_speech_prob"), F.coalesce(F.avg("avg_logprob"), F.lit(-10.0)).alias("avg_logprob"), F.coalesce(F.max("compression_ratio"), F.lit(0.0)).alias("compression_ratio"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))


def verify(checks: dict[str, DataFrame]) -> DataFrame:
    """name -> one-row frames with a boolean ``ok``: all of them as (check, ok)."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.col("ok"))
        out = row if out is None else out.union(row)
    return out


def gauge(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """How many intervals of a key are open right after each start (its own included)."""
    points = intervals.select(key, F.col(start).alias("at"), F.lit(1).alias("d"), F.lit(1).alias("opens")).union(intervals.select(key, F.col(end), F.lit(-1), F.lit(0)))
    # one row a moment, so that what happens at once counts as one step
    moments = points.groupBy(key, "at").agg(F.sum("d").alias("d"), F.max("opens").alias("opens"))
    return _running(moments, [key], "at", "d").filter("opens = 1").select(key, "at", F.col("upto").alias("open"))


def streaks(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: runs of equal neighbours as (by, value, start, length)."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    island = marked.withColumn("island", F.sum("new").over(w))
    return island.groupBy(by, "island").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


def rounded(c: Column | str, digits: int) -> Column:
    return half_even(c, digits)
