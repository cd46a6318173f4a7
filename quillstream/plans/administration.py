"""Queries of builds, requests, transcripts, signals and nested pages over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import builds, corpus, keyed, pairs, requests, sessions, substrings
from ..sources.session import shared_dir, table
from ..streaming import guards
from .registry import query
from .scripted import _EVENTS, _words, scripted

# ------------------------------------------------------------------ builds


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as lines of ids: passage, number, ids (null for some), unstable, words."""
    ids = F.when(F.col("l_linestatus") == "O", F.sequence(F.lit(1), (F.col("l_quantity") % 4).cast("int") + 1))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passage"), (F.col("l_linenumber") * F.lit(10_000_000_000) + F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("number"), ids.alias("ids"), F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("unstable"), F.col("l_quantity").cast("bigint").alias("words"), "l_partkey")


@query(
    """WITH l AS (SELECT l_orderkey AS passage, l_linenumber * 10000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS number, l_linestatus = 'O' AS has, l_returnflag, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM lineitem)
SELECT passage, CAST(number AS BIGINT) AS number, CAST(first AS BIGINT) AS first FROM l WHERE has AND l_returnflag <> 'R'"""
)
def usable_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.usable(_lines(spark, sf_dir), "passage", "number", F.col("words")).select("passage", "number", "first")


@query(
    """WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01') ORDER BY o_orderkey LIMIT 120)
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 50) AS INT) AS commit FROM t"""
)
def builds_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz '1996-06-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return builds.next_builds(items, done, "o_orderkey", 120, o_orderstatus="O", o_orderpriority=None).select("o_orderkey", "commit")


@query("SELECT count(*) FILTER (l_linestatus = 'O') AS built, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS flagged, count(*) FILTER (l_linestatus <> 'O') AS failed FROM lineitem")
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builds.build_counters(_lines(spark, sf_dir))


@query("SELECT true AS same")
def same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return builds.same_rows(o, o.filter("o_custkey % 2 = 0").union(o.filter("o_custkey % 2 = 1")))


@query("SELECT n_nationkey AS source, n_regionkey AS target, n_regionkey = n_nationkey % 5 AS found FROM nation")
def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    have = n.select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") % 5).alias("target"))
    return pairs.pair_known(have, n.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target")))


# ------------------------------------------------------------------ requests

_REQUESTS = """
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'not-an-id' ELSE upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR)), 21, 12) END AS id,
  c_name AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 120 END AS surah, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS start, CASE c_mktsegment WHEN 'MACHINERY' THEN '' ELSE c_mktsegment END AS origin FROM customer),
s AS (SELECT n_nationkey + 90 AS surah, n_nationkey % 12 + 3 AS size FROM nation UNION ALL SELECT n_nationkey, 20 FROM nation),
j AS (SELECT r.*, CASE WHEN origin NOT IN ('', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'origin' WHEN id = 'not-an-id' THEN 'id' WHEN r.surah NOT BETWEEN 1 AND 114 THEN 'surah' WHEN start < 1 THEN 'start' WHEN r.surah IS NOT NULL AND start IS NOT NULL AND (size IS NULL OR start > size) THEN 'start' END AS reason
  FROM r LEFT JOIN s ON s.surah = r.surah)"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    h = F.md5(F.col("c_custkey").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    made = F.concat_ws("-", F.upper(part(1, 8)), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    k = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(
        k, F.when(k % 7 == 0, "not-an-id").otherwise(made).alias("id"), F.col("c_name").alias("user_id"), F.when(k % 11 != 0, k % 120).alias("surah_id"),
        F.when(k % 13 != 0, F.col("c_nationkey")).alias("start_ayah"), F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("origin"),
    )
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    passages = n.select((F.col("n_nationkey") + 90).alias("id"), (F.col("n_nationkey") % 12 + 3).alias("ayah_count")).union(n.select("n_nationkey", F.lit(20)))
    return r, passages, ["BUILDING", "AUTOMOBILE", "HOUSEHOLD"]


@query(f"{_REQUESTS} SELECT lower(id) AS id, user_id, CAST(surah AS INT) AS surah_id, CAST(start AS INT) AS start_ayah, CASE WHEN surah IS NULL THEN 'detecting' ELSE 'created' END AS status FROM j WHERE reason IS NULL")
def accepted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.new_sessions(*_requests(spark, sf_dir), F.expr("timestamp '2024-01-01'")).select("id", "user_id", "surah_id", "start_ayah", "status")


@query(f"{_REQUESTS} SELECT c_custkey, reason FROM j WHERE reason IS NOT NULL")
def rejected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.judged(*_requests(spark, sf_dir)).filter("reason is not null").select("c_custkey", "reason")


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 2 END AS errors, o_totalprice AS duration_sec
FROM orders"""
)
def summary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    rows = o.select("id", F.lit(1).alias("surah_id"), F.col("o_orderstatus").alias("status"))
    detail = F.when(F.col("o_orderkey") % 3 == 0, '{"mode": "words"}').otherwise('{"errors": ["a", "b"]}')
    zero = [F.lit(0).alias(c) for c in ("words_ok", "words_missed", "ayahs_missed", "jumps")]
    summaries = o.select(F.col("id").alias("session_id"), F.col("o_totalprice").alias("duration_sec"), *zero, detail.alias("detail"))
    return requests.summary_view(rows, summaries).select("session_id", "status", F.size("errors").alias("errors"), "duration_sec")


# ------------------------------------------------------------------ what clients show


@query(f"{_EVENTS}, t AS (SELECT k, count(*) AS total FROM w GROUP BY k), h AS (SELECT k, count(DISTINCT idx) AS heard FROM events_of WHERE type = 'WORD_OK' GROUP BY k) SELECT CAST(k AS VARCHAR) AS session_id, total, coalesce(heard, 0) AS heard FROM t LEFT JOIN h USING (k)")
def scripted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _words(spark, sf_dir).groupBy("k", "line").agg(F.count(F.lit(1)).alias("size")).select(F.col("k").cast("string").alias("session_id"), "size")
    return sessions.progress(sessions.final_state(sessions.persisted(scripted(spark, sf_dir))), sizes)


_SHOWN = """
WITH e AS (SELECT user_id AS session_id, event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS ayah, CASE event_id % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'confirmed' ELSE 'revoked' END AS state,
  CASE event_type WHEN 'click' THEN 'MISSED_AYAH' WHEN 'signup' THEN 'MUTASHABEH_JUMP' ELSE 'WORD_OK' END AS type FROM events),
l AS (SELECT *, CASE WHEN state = 'revoked' THEN lag(event_id) OVER (PARTITION BY session_id, type ORDER BY event_id) END AS refers_to FROM e)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kind, k = F.col("event_type"), F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("ayah"), F.when(k == 0, "provisional").when(k == 1, "confirmed").otherwise("revoked").alias("state"),
        F.when(kind == "click", "MISSED_AYAH").when(kind == "signup", "MUTASHABEH_JUMP").otherwise("WORD_OK").alias("type"),
    )
    before = F.lag("event_id").over(Window.partitionBy("session_id", "type").orderBy("event_id"))
    return e.withColumn("refers_to", F.when(F.col("state") == "revoked", before))


@query(f"{_SHOWN} SELECT session_id, ayah, state FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ayah ORDER BY event_id DESC) AS k FROM l WHERE type = 'MISSED_AYAH') WHERE k = 1 AND state <> 'revoked'")
def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.final_lines(_shown(spark, sf_dir))


@query(
    f"""{_SHOWN}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS k FROM l WHERE type = 'MUTASHABEH_JUMP' AND state <> 'revoked') WHERE k = 1)
SELECT session_id, event_id, state FROM s WHERE NOT EXISTS (SELECT 1 FROM l r WHERE r.session_id = s.session_id AND r.state = 'revoked' AND r.type = 'MUTASHABEH_JUMP' AND r.refers_to = s.event_id AND r.event_id > s.event_id)"""
)
def jump_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.final_jump(_shown(spark, sf_dir))


# ------------------------------------------------------------------ transcripts, ids, signals


@query(
    """WITH s AS (SELECT user_id, max(value / 200) AS nsp, avg(-value / 60) AS alp, max(value / 50) AS cr, string_agg(event_type, ' ' ORDER BY event_id) AS text FROM events GROUP BY 1)
SELECT user_id, nsp > 0.6 OR alp < -1.0 OR cr > 2.4 OR user_id % 5 / 4.0 < 0.4 AS gated, length(text) AS size, md5(text) AS digest FROM s WHERE text NOT IN ('view', 'click')"""
)
def transcript_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    segments = e.select("user_id", F.col("event_id").alias("seq"), (F.col("value") / 200).alias("no_speech_prob"), (-F.col("value") / 60).alias("avg_logprob"), (F.col("value") / 50).alias("compression_ratio"), F.col("event_type").alias("text"))
    t = sessions.confidence(segments, "user_id").withColumn("seconds", (F.col("user_id") % 5) / 4.0).withColumn("normal", F.col("text"))
    kept = sessions.without_phrases(sessions.gate(t), ["view", "click"])
    return kept.select("user_id", "gated", F.length("text").cast("bigint").alias("size"), F.md5("text").alias("digest"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_quantity AS BIGINT) % 4 AS id, lag(CAST(l_quantity AS BIGINT) % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS before FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY l_linenumber, l_extendedprice) FILTER (id <> 0 AND id IS DISTINCT FROM before), '') AS ids FROM p GROUP BY 1"""
)
def collapsed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", (F.col("l_quantity").cast("int") % 4).alias("id")))), lambda x: x["id"]).alias("raw"))
    return g.select("l_orderkey", F.array_join(numeric.collapse(F.col("raw")), ",").alias("ids"))


@query(
    """WITH s AS (SELECT l_orderkey, list(CAST(l_quantity * 655 AS BIGINT) - 16384 ORDER BY l_linenumber, l_extendedprice) AS pcm FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, pcm, list_transform(pcm, lambda x: x / 32768.0) AS samples FROM s),
r AS (SELECT *, sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples)) AS rms FROM f)
SELECT l_orderkey, round(rms, 9) AS rms, round(CASE WHEN l_orderkey % 4 = 0 THEN 0.0 ELSE least(1.0, rms * 4) END, 9) AS level, list_sum(list_transform(samples, lambda x: CAST(round_even(greatest(-1.0, least(1.0, x)) * 32767, 0) AS BIGINT))) AS total,
  CAST(floor(len(samples) / 3.0) AS INT) AS resampled FROM r"""
)
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", ((F.col("l_quantity") * 655).cast("bigint") - 16384).alias("s")))), lambda x: x["s"])
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pcm.alias("pcm")).withColumn("samples", numeric.pcm_to_float(F.col("pcm"))).withColumn("power", numeric.rms(F.col("samples")))
    level = numeric.level(F.col("power"), F.col("l_orderkey") % 4 == 0)
    total = F.aggregate(numeric.float_to_pcm(F.col("samples")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("l_orderkey", F.round("power", 9).alias("rms"), F.round(level, 9).alias("level"), total.alias("total"), F.size(numeric.resample(F.col("samples"), 48000, 16000)).alias("resampled"))


# ------------------------------------------------------------------ nested pages, Arabic forms

_LETTERS = "أبتثجحخدذر"
_MARKED = "َُِّٰـآئؤى"


@query(
    f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linenumber % 3 <> 0 AS word, translate(CAST(l_partkey * 7919 AS VARCHAR), '0123456789', '{_LETTERS}') || translate(CAST(l_suppkey AS VARCHAR), '0123456789', '{_MARKED}') AS uthmani, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ةرزسشصضطظع') || ' x' END AS imlaei FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS position, CASE WHEN imlaei = '' THEN uthmani ELSE imlaei END AS form FROM w WHERE word)
SELECT l_orderkey AS ayah_id, CAST(position AS INT) AS position, uthmani AS text_uthmani, form AS text_imlaei,
  trim(regexp_replace(regexp_replace(translate(regexp_replace(form, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{0640}}]', '', 'g'), 'آأإٱؤئىة', 'ااااوييه'), '[^\\x{{0621}}-\\x{{064A}} ]', '', 'g'), ' +', ' ', 'g')) AS text_normalized FROM k"""
)
def flattened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words of nested pages: every third isn't a word, some have one form only."""
    uthmani = F.concat(F.translate((F.col("l_partkey") * 7919).cast("string"), "0123456789", _LETTERS), F.translate(F.col("l_suppkey").cast("string"), "0123456789", _MARKED))
    imlaei = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.translate(F.col("l_partkey").cast("string"), "0123456789", "ةرزسشصضطظع"), F.lit(" x")))
    kind = F.when(F.col("l_linenumber") % 3 != 0, "word").otherwise("end")
    word = F.struct("l_linenumber", "l_extendedprice", F.col("l_partkey").alias("id"), kind.alias("char_type_name"), uthmani.alias("text_uthmani"), imlaei.alias("text_imlaei"))
    verses = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(word)).alias("words"))
    pages = verses.groupBy((F.col("l_orderkey") % 50).alias("page")).agg(F.collect_list(F.struct(F.col("l_orderkey").alias("id"), F.lit("").alias("verse_key"), "words")).alias("verses"))
    return corpus.flatten_verses(pages).select(F.col("ayah_id").cast("bigint").alias("ayah_id"), "position", "text_uthmani", "text_imlaei", "text_normalized")


@query(
    """WITH RECURSIVE r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS server, event_id AS seq, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i, epoch_us(ts) / 1000000.0::DOUBLE AS secs,
  CASE WHEN event_type IN ('view', 'click') THEN 'open' ELSE 'end' END AS action, CAST(user_id % 60 AS VARCHAR) AS session, CAST(event_id % 3 AS VARCHAR) AS address FROM events),
fold(server, i, held, seq, session, outcome) AS (
  SELECT DISTINCT server, 0::BIGINT, []::STRUCT(session VARCHAR, address VARCHAR, until DOUBLE)[], NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM r
  UNION ALL
  SELECT server, i, CASE WHEN action <> 'open' THEN list_filter(live, lambda x: x.session <> asked) WHEN verdict = 'admitted' THEN list_append(live, {'session': asked, 'address': address, 'until': secs + 5400}) ELSE live END,
    seq, asked, CASE WHEN action = 'open' THEN verdict END
  FROM (SELECT *, CASE WHEN list_contains(list_transform(live, lambda x: x.session), asked) THEN 'duplicate' WHEN len(live) >= 3 THEN 'server full' WHEN len(list_filter(live, lambda x: x.address = who)) >= 2 THEN 'address full' ELSE 'admitted' END AS verdict
    FROM (SELECT r.server, r.i, r.seq, r.action, r.session AS asked, r.address, r.address AS who, r.secs, list_filter(f.held, lambda x: x.until > r.secs) AS live FROM fold f JOIN r ON r.server = f.server AND r.i = f.i + 1)))
SELECT server, seq, session, outcome FROM fold WHERE outcome IS NOT NULL"""
)
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to twenty servers: views and clicks ask for a session, others give it back."""
    e, text = table(spark, sf_dir, "events"), lambda c: c.cast("string")
    action = F.when(F.col("event_type").isin("view", "click"), "open").otherwise("end")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    asked = e.select(text(F.col("user_id") % 20).alias("server"), F.col("event_id").alias("seq"), at.alias("at"), action.alias("action"), text(F.col("user_id") % 60).alias("session"), text(F.col("event_id") % 3).alias("address"))
    return guards.admit(asked)


@query(
    """WITH c AS (SELECT o_custkey AS k, CASE WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 0 WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 1 ELSE 2 END AS batch, count(*) AS n, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS s FROM orders GROUP BY ALL)
SELECT k, arg_max(n, batch) AS n, arg_max(s, batch) FILTER (s IS NOT NULL) AS s FROM c GROUP BY k"""
)
def keyed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three spans as batches of a keyed table; one of them comes twice."""
    o, day = table(spark, sf_dir, "orders"), lambda y: F.expr(f"timestamp_ntz '{y}-01-01'")
    batch = F.when(F.col("o_orderdate") < day(1994), 0).when(F.col("o_orderdate") < day(1996), 1).otherwise(2)
    status = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))
    changes = o.groupBy(F.col("o_custkey").alias("k"), batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), status.alias("s"))
    kept = keyed.KeyedTable(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", "k", "k long, n long, s string", 16)
    for b in (0, 1, 1, 2):
        kept.upsert(changes.filter(F.col("batch") == b).drop("batch"), b)
    return kept.read()


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substr(b.text, 11, 12)))")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve letters of a benchmark item, by the trigrams of blocks of rows."""
    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.substring("text", 11, 12).alias("literal"))
    found = substrings.search_once(docs, asked, "doc_id", "text", 4)
    return found.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"))
