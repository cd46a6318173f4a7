"""Requests of clients: validated, split into new sessions and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COLUMNS

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Fixed value: passages are numbered from 1 to this.
PASSAGES = 114


def parse_uuid(c: Column | str) -> Column:
    """Lower case; null for anything that isn't one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(UUID), F.lower(c))


def origin_allowed(origin: Column, allowed: list[str]) -> Column:
    """A request without an origin passes; one with an origin must be listed."""
    return F.coalesce(origin, F.lit("")).isin("", *allowed)


def judged(requests: DataFrame, passages: DataFrame, allowed: list[str]) -> DataFrame:
    """requests: id, user_id, surah_id, start_ayah, origin; passages: id, ayah_count. Adds
    ``reason``: null for a request that passes. Both places may be null (to be detected)."""
    known = passages.select(F.col("id").alias("surah_id"), "ayah_count")
    r = requests.join(F.broadcast(known), "surah_id", "left")  # at most PASSAGES rows
    surah, start = F.col("surah_id"), F.col("start_ayah")
    reason = (
        F.when(~origin_allowed(F.col("origin"), allowed), "origin")
        .when(parse_uuid("id").isNull(), "id")
        .when(surah.isNotNull() & ~surah.between(1, PASSAGES), "surah")
        .when(start.isNotNull() & (start < 1), "start")
        .when(start.isNotNull() & surah.isNotNull() & (F.col("ayah_count").isNull() | (start > F.col("ayah_count"))), "start")
    )
    return r.withColumn("reason", reason)


def new_sessions(requests: DataFrame, passages: DataFrame, allowed: list[str], now: Column) -> DataFrame:
    """Rows of the sessions table for the requests that pass, ready to be appended."""
    good = judged(requests, passages, allowed).filter("reason is null")
    status = F.when(F.col("surah_id").isNull(), "detecting").otherwise("created")
    rows = good.select(parse_uuid("id").alias("id"), "user_id", F.col("surah_id").cast("int").alias("surah_id"), F.col("start_ayah").cast("int").alias("start_ayah"), status.alias("status"), now.cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    return rows.select(*COLUMNS["sessions"])


def errors_of(detail: Column | str) -> Column:
    """The list of errors in a summary's JSON detail; an empty one where it has none."""
    c = F.col(detail) if isinstance(detail, str) else detail
    return F.coalesce(F.from_json(F.get_json_object(c, "$.errors"), "array<string>"), F.array().cast("array<string>"))


def summary_view(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """What the summary page gets: a session's row with its summary, errors as a list."""
    s = summaries.select("session_id", "duration_sec", "words_ok", "words_missed", "ayahs_missed", "jumps", errors_of("detail").alias("errors"))
    return sessions.join(s, sessions.id == s.session_id).select("session_id", "surah_id", "status", "duration_sec", "words_ok", "words_missed", "ayahs_missed", "jumps", "errors")
