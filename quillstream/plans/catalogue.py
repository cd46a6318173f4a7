"""Registered queries of the engine over the driver's tables, and the SQL each one equals.

documents stand for passages (line = verse, word = token), benchmark for query passages,
conversations for live sessions, events for the event log; orders, lineitem and customer
carry the relational operators. Queries without SQL are order-dependent folds or fuzzy kernels;
tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import alignment, corpus, pairs, search, sessions
from ..sources.session import materialise, table
from ..streaming import detection, guards
from ..streaming import session as live
from . import administration, scripted  # noqa: F401 (they register their queries)
from .registry import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "relocation_search"


# ------------------------------------------------------------------ corpus and searches

_WORDS = r"""
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
toks AS (SELECT doc_id, line_no, list_filter(string_split_regex(regexp_replace(lower(line), '[^a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF} \x09-\x0D]', '', 'g'), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM lines),
flat AS (SELECT doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS position FROM toks),
words AS (SELECT doc_id, line_no, position, word, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, position) - 1 AS pos FROM flat)"""
_QUERY_WORDS = r"""
asked AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF} \x09-\x0D]', '', 'g'), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
qwords AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM asked)"""
_RELOCATION = f"""
WITH {_WORDS.strip()}, {_QUERY_WORDS.strip()},
g AS (SELECT * FROM (SELECT doc_id, pos, line_no, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL),
q AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT item_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS gram FROM qwords WINDOW w AS (PARTITION BY item_id ORDER BY i)) WHERE gram IS NOT NULL),
run AS (SELECT item_id, doc_id, floor((pos - i) / 3.0) AS diagonal, count(*) AS matched, min(pos) AS anchor, min(line_no) AS line_no, min(i) AS fi, count(*) / any_value(n)::DOUBLE AS score
        FROM g JOIN q USING (gram) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fi, doc_id, anchor) AS rank FROM run)"""


def _lcs(pairs: str) -> str:
    """Length of the longest common subsequence of all pairs (a, b): bits of a whole number stand
    for the letters of a, and each letter of b is one step of the recursion."""
    return f"""lcs(a, b, j, v) AS (
  SELECT a, b, 1, (1::HUGEINT << length(a)) - 1 FROM {pairs}
  UNION ALL
  SELECT a, b, j + 1, ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length(a)) - 1)
  FROM (SELECT *, CAST(list_sum(list_transform(range(1, length(a) + 1), lambda x: CASE WHEN a[x] = b[j] THEN 1::HUGEINT << CAST(x - 1 AS INT) ELSE 0::HUGEINT END)) AS HUGEINT) AS m FROM lcs WHERE j <= length(b))),
alike AS (SELECT a, b, (length(a) - bit_count(v)) * 200.0 / (length(a) + length(b)) AS score FROM lcs WHERE j = length(b) + 1)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.passages(table(spark, sf_dir, "documents"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), text.tokens("text").alias("tokens"))


def _named(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("query").alias("item_id"), "rank", F.col("passage").alias("doc_id"), "line_no", F.col("anchor").cast("bigint").alias("anchor"), "matched", F.round("score", 6).alias("score"))


@query(f"{_RELOCATION} SELECT item_id, rank, doc_id, line_no, anchor, matched, round(score, 6) AS score FROM hits WHERE rank <= 5")
def relocation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(search.relocation(_parts(spark, sf_dir), _asked(spark, sf_dir)))


@query(
    f"""{_RELOCATION},
t AS (SELECT * FROM hits WHERE rank <= 5), f AS (SELECT * FROM t WHERE rank = 1),
o AS (SELECT t.item_id, max(t.score) AS s2 FROM t JOIN f ON t.item_id = f.item_id WHERE t.doc_id <> f.doc_id OR abs(t.line_no - f.line_no) > 2 GROUP BY 1)
SELECT f.item_id, f.doc_id, f.line_no, round(f.score, 6) AS score, round(f.score - coalesce(s2, 0), 6) AS lead, f.score >= 0.65 AND (s2 IS NULL OR f.score - s2 >= 0.2) AS locked
FROM f LEFT JOIN o ON f.item_id = o.item_id"""
)
def relocation_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = search.margin(search.relocation(_parts(spark, sf_dir), _asked(spark, sf_dir)))
    return m.select(F.col("query").alias("item_id"), F.col("passage").alias("doc_id"), "line_no", F.round("score", 6).alias("score"), F.round("lead", 6).alias("lead"), "locked")


#: From qwords (item_id, i, word) to their best places, ``top``.
_LOCATION = f"""v AS (SELECT word, count(*) AS n, min((doc_id, pos)) AS first FROM words GROUP BY 1),
u AS (SELECT DISTINCT word FROM qwords WHERE word NOT IN (SELECT word FROM v)),
-- which letters a word has once and twice, as bits: a bound of what two words can share
c AS (SELECT word, list_transform(range(0, 26), lambda x: length(word) - length(replace(word, chr(CAST(97 + x AS INT)), ''))) AS l FROM (SELECT word FROM v UNION SELECT word FROM u)),
m AS (SELECT word, list_sum(list_transform(range(0, 26), lambda x: CASE WHEN l[x + 1] >= 1 THEN 1::HUGEINT << CAST(x AS INT) ELSE 0 END + CASE WHEN l[x + 1] >= 2 THEN 1::HUGEINT << CAST(x + 26 AS INT) ELSE 0 END)) AS mask,
  length(word) - list_sum(list_transform(l, lambda y: least(y, 2))) AS rest FROM c),
pairs AS (SELECT x.word AS a, y.word AS b FROM u JOIN m x ON x.word = u.word JOIN v ON least(length(u.word), length(v.word)) * 200.0 >= 78 * (length(u.word) + length(v.word)) JOIN m y ON y.word = v.word
  WHERE (bit_count(CAST(x.mask AS HUGEINT) & CAST(y.mask AS HUGEINT)) + least(x.rest, y.rest)) * 200.0 >= 78 * (length(x.word) + length(y.word))),
{_lcs("pairs")},
fix AS (SELECT a AS word, b AS known FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, first) AS k FROM alike JOIN v ON v.word = b WHERE score >= 78) WHERE k = 1),
q AS (SELECT item_id, i, coalesce(known, word) AS word, count(*) OVER (PARTITION BY item_id) AS size FROM qwords LEFT JOIN fix USING (word)),
run AS (SELECT item_id, doc_id, count(DISTINCT i) AS matched, min(w.pos) AS anchor, min(line_no) AS line_no, min(i) AS fi, any_value(size) AS size
  FROM q JOIN v USING (word) JOIN words w USING (word) WHERE v.n <= 3000 GROUP BY item_id, doc_id, floor((w.pos - i) / 3.0) HAVING count(DISTINCT i) >= 2),
top AS (SELECT *, matched / size::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY matched / size::DOUBLE DESC, fi, doc_id, anchor) AS rank FROM run)"""


@query(f"WITH RECURSIVE {_WORDS.strip()}, {_QUERY_WORDS.strip()}, {_LOCATION} SELECT item_id, rank, doc_id, line_no, anchor, matched, round(score, 6) AS score FROM top WHERE rank <= 5")
def location_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(search.location(_parts(spark, sf_dir), _asked(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_WORDS.strip()}, {_QUERY_WORDS.strip().replace("qwords AS", "spoken AS")},
-- four words a row; a window is the last sixteen words up to a row
rows_of AS (SELECT DISTINCT item_id AS item, i // 4 + 1 AS seq FROM spoken), ends AS (SELECT item, seq, least(seq * 4, (SELECT count(*) FROM spoken s WHERE s.item_id = item)) AS upto FROM rows_of),
qwords AS (SELECT item || '/' || seq AS item_id, i - greatest(upto - 16, 0) AS i, word FROM ends JOIN spoken ON item_id = item AND i < upto AND i >= upto - 16 WHERE upto >= 4),
{_LOCATION},
hit AS (SELECT CAST(split_part(item_id, '/', 1) AS BIGINT) AS item, CAST(split_part(item_id, '/', 2) AS BIGINT) AS seq, doc_id, line_no, score, rank FROM top WHERE rank <= 5),
best AS (SELECT * FROM hit WHERE rank = 1),
rival AS (SELECT h.item, h.seq, max(h.score) AS other FROM hit h JOIN best b ON b.item = h.item AND b.seq = h.seq WHERE h.doc_id <> b.doc_id OR abs(h.line_no - b.line_no) > 2 GROUP BY ALL),
seen AS (SELECT b.*, b.score >= 0.65 AND (other IS NULL OR b.score - other >= 0.2) AS clear FROM best b LEFT JOIN rival r ON r.item = b.item AND r.seq = b.seq),
-- the last six votes of weaker windows
vote AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq) AS v FROM seen WHERE NOT clear AND score >= 0.4),
tally AS (SELECT a.item, a.seq, b.doc_id, count(*) AS n, arg_max(b.line_no, (b.score, -b.v)) AS line_no, max(b.score) AS score FROM vote a JOIN vote b ON b.item = a.item AND b.v BETWEEN a.v - 5 AND a.v GROUP BY ALL),
lead AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY item, seq ORDER BY n DESC), 0) AS next, row_number() OVER (PARTITION BY item, seq ORDER BY n DESC) AS k FROM tally),
found AS (SELECT item, seq, doc_id, line_no, score FROM seen WHERE clear UNION ALL SELECT item, seq, doc_id, line_no, score FROM lead WHERE k = 1 AND n >= 3 AND n - next >= 2)
SELECT item AS item_id, seq, doc_id, line_no, round(score, 6) AS score FROM found QUALIFY row_number() OVER (PARTITION BY item ORDER BY seq) = 1"""
)
def detected_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as sessions of four words a row: where and when each is located."""
    said = corpus.entries(_asked(spark, sf_dir), "query", "tokens", "token").withColumn("seq", F.floor(F.col("i") / 4) + 1)
    rows = said.groupBy(F.col("query").cast("string").alias("session_id"), F.col("seq").cast("int").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens"))
    found = detection.locks(rows, _parts(spark, sf_dir))
    return found.select(F.col("session_id").cast("bigint").alias("item_id"), F.col("seq").cast("bigint").alias("seq"), F.col("passage").alias("doc_id"), "line_no", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_WORDS.strip()}, {_QUERY_WORDS.strip()},
g AS (SELECT DISTINCT item, gram FROM (SELECT doc_id * 1000000 + line_no AS item, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS gram FROM words WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY position)) WHERE gram IS NOT NULL),
q AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT item_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS gram FROM qwords WINDOW w AS (PARTITION BY item_id ORDER BY i)) WHERE gram IS NOT NULL),
v AS (SELECT item_id, item, count(*) AS votes, count(*) / any_value(n)::DOUBLE AS score FROM g JOIN q USING (gram) GROUP BY ALL)
SELECT item_id, item, votes, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, item) AS rank FROM v) WHERE rank <= 5"""
)
def id_vote_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _parts(spark, sf_dir).select("passage", F.posexplode_outer("lines").alias("i", "ids")).select((F.col("passage") * 1_000_000 + F.col("i") + 1).alias("item"), "ids")
    found = search.id_votes(lines, _asked(spark, sf_dir).select("query", F.col("tokens").alias("ids")))
    return found.select(F.col("query").alias("item_id"), "item", "votes", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH RECURSIVE {_WORDS.strip()},
r AS (SELECT doc_id, line_no, position, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS gram, string_agg(word, ' ') OVER (PARTITION BY doc_id, line_no ORDER BY position ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead,
  count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM words WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY position)),
g AS (SELECT doc_id, line_no, gram, arg_min(ahead, position) AS ahead FROM r WHERE gram IS NOT NULL AND n >= 4 GROUP BY 1, 2, 3),
few AS (SELECT gram FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
x AS (SELECT * FROM g WHERE gram IN (SELECT gram FROM few)),
met AS (SELECT DISTINCT p.doc_id AS d1, p.line_no AS l1, q.doc_id AS d2, q.line_no AS l2, p.ahead AS wa, q.ahead AS wb FROM x p JOIN x q ON p.gram = q.gram AND (p.doc_id < q.doc_id OR p.doc_id = q.doc_id AND p.line_no < q.line_no)),
pairs AS (SELECT DISTINCT wa AS a, wb AS b FROM met WHERE wa <> wb AND least(length(wa), length(wb)) * 200.0 >= 72 * (length(wa) + length(wb)) AND length(wa) <= 120),
{_lcs("pairs")},
best AS (SELECT d1, l1, d2, l2, max(CASE WHEN wa = wb THEN 100.0 ELSE score END) AS score FROM met LEFT JOIN alike ON a = wa AND b = wb GROUP BY ALL HAVING max(CASE WHEN wa = wb THEN 100.0 ELSE score END) >= 72),
o AS (SELECT d1, l1, d2, l2, round_even(score / 100, 4) AS score FROM best)
SELECT d1 AS source_doc, l1 AS source_line, d2 AS target_doc, l2 AS target_line, score FROM o UNION ALL SELECT d2, l2, d1, l1, score FROM o"""
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.similar_pairs(_parts(spark, sf_dir))
    at = lambda end: [F.col(f"{end}.passage").alias(f"{end}_doc"), F.col(f"{end}.line_no").cast("bigint").alias(f"{end}_line")]
    return found.select(*at("source"), *at("target"), "score")


@query(
    f"""{_RELOCATION.replace("WITH", "WITH RECURSIVE", 1)},
top AS (SELECT item_id, doc_id, anchor FROM hits WHERE rank = 1),
near AS (SELECT q.item_id, q.i, q.word AS token, w.pos, w.word, w.pos - (t.anchor + q.i) AS delta FROM qwords q JOIN top t USING (item_id) JOIN words w ON w.doc_id = t.doc_id AND w.pos BETWEEN t.anchor + q.i - 8 AND t.anchor + q.i + 11),
pairs AS (SELECT DISTINCT token AS a, word AS b FROM near WHERE token <> word AND least(length(token), length(word)) * 200.0 >= 78 * (length(token) + length(word))),
{_lcs("pairs")},
scored AS (SELECT near.*, CASE WHEN token = word THEN 100.0 ELSE alike.score END AS score FROM near LEFT JOIN alike ON a = token AND b = word),
best AS (SELECT *, row_number() OVER (PARTITION BY item_id, i ORDER BY CASE WHEN delta = 0 AND score >= 86 THEN 0 ELSE 1 END, round_even(score / 4, 0) DESC, abs(delta), delta < 0) AS k FROM scored WHERE score >= 78)
SELECT item_id, CAST(i AS INT) AS i, CAST(pos AS BIGINT) AS pos, round(score, 6) AS score FROM best WHERE k = 1"""
)
def batch_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the surroundings of its best relocation hit."""
    parts, asked = _parts(spark, sf_dir), _asked(spark, sf_dir)
    hits = materialise(search.relocation(parts, asked).filter("rank = 1").select("query", "passage", "anchor"), "hits")
    tokens = corpus.entries(asked, "query", "tokens", "token").join(hits, "query").select(F.col("query").alias("key"), "i", "token", "passage", (F.col("anchor") + F.col("i")).alias("pointer"))
    near = parts.join(hits.select("passage").distinct(), "passage", "left_semi")  # before texts are split
    return alignment.align(tokens, corpus.words(near)).select(F.col("key").alias("item_id"), "i", "pos", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS.strip()} SELECT doc_id, line_no, count(*) AS n_words, min(pos) AS first_pos, min(word) AS least, max(length(word)) AS longest FROM words GROUP BY 1, 2")
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_sums(_parts(spark, sf_dir)).withColumnRenamed("passage", "doc_id")


@query(
    f"""WITH {_WORDS.strip()},
g AS (SELECT DISTINCT doc_id, line_no, gram FROM (SELECT doc_id, line_no, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS gram FROM words WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY position)) WHERE gram IS NOT NULL)
SELECT gram, count(*) AS df FROM g GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60"""
)
def blocking_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_gram_counts(_parts(spark, sf_dir), 3).filter("df between 2 and 60")


@query(
    r"""WITH toks AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF} \x09-\x0D]', '', 'g'), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM conversations),
w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM toks),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, i DESC) AS back FROM w)
SELECT conv_id, string_agg(word, ' ' ORDER BY back DESC) AS tail, count(*) AS n FROM r WHERE back <= 16 GROUP BY 1"""
)
def last_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens("text").alias("ws"))
    w = t.select("conv_id", "turn", F.posexplode_outer("ws").alias("i", "word")).filter("word is not null")
    r = w.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("i").desc()))).filter("back <= 16")
    kept = r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("o"), "word"))).alias("l"), F.count(F.lit(1)).alias("n"))
    return kept.select("conv_id", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("tail"), "n")


# ------------------------------------------------------------------ live sessions


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a session over its own words: segments of up to twelve tokens, every
    ninth token unsaid, and every fifth turn."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").cast("int").alias("turn"), text.tokens("text").alias("ws"))
    w = t.select("conv_id", "turn", F.posexplode_outer("ws").alias("i", "word")).filter("word is not null")
    turns = w.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("ws"))
    chunk = (F.col("turn") * 1000 + F.floor(F.col("i") / 12) + 1).cast("int").alias("seq")
    said = w.filter("turn % 5 <> 3 and i % 9 <> 8").groupBy(F.col("conv_id").cast("string").alias("session_id"), chunk).agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("ws"))
    said = said.select("session_id", "seq", F.lit("tokens").alias("kind"), F.to_json(F.struct(F.transform("ws", lambda x: x["word"]).alias("tokens"))).alias("body"))
    line = F.col("conv_id") * 1000 + F.col("turn")
    entry = F.array((line * 1000 + F.col("i")).cast("string"), F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"), line.cast("string"), (F.col("i") + 1).cast("string"), F.to_json(F.array("word")))
    words = w.withColumn("e", F.concat(F.lit("["), F.concat_ws(",", F.slice(entry, 1, 5)), F.lit(","), F.substring(F.get(entry, F.lit(5)), 2, 1_000_000)))
    opened = words.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "i", "e"))).alias("ws")).select(F.col("conv_id").cast("string").alias("session_id"), F.lit(0).alias("seq"), F.lit("open").alias("kind"), F.concat(F.lit('{"opening": false, "reference": ['), F.concat_ws(",", F.transform("ws", lambda x: x["e"])), F.lit("]}")).alias("body"))
    ended = turns.groupBy("conv_id").agg(F.max("turn").alias("t")).select(F.col("conv_id").cast("string").alias("session_id"), ((F.col("t") + 1) * 1000).alias("seq"), F.lit("end").alias("kind"), F.lit("{}").alias("body"))
    return opened.union(said).union(ended)


@query()
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.track_batch(session_rows(spark, sf_dir))


@query()
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read four times below; the fold runs once, and payloads aren't needed
    events = sessions.persisted(live.track_batch(session_rows(spark, sf_dir))).select("session_id", "event_id", "type", "state", "refers_to")
    summary = sessions.summary_live(materialise(events, "report-events"))
    return summary.join(sessions.accuracy(summary), "session_id")


@query(
    """WITH RECURSIVE frames AS (SELECT CAST(user_id AS VARCHAR) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, sin(event_id / 400.0) * 0.4 + 0.4 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) / 500.0 AS p FROM events),
-- a buffer of samples from start on; cut: how much of it closes as a segment, keep: where the next one starts
run(s, i, start, size, speaking, spoken, silent, replay, quiet, seg_start, seg_end, seg_replay) AS (
  SELECT DISTINCT s, 0, 0, 0, false, false, 0, false, -1, NULL::INT, NULL::INT, NULL::BOOLEAN FROM frames
  UNION ALL
  SELECT s, i, start + keep, size - keep, speaking, spoken AND NOT (how IN ('pause', 'nothing')), CASE WHEN how IN ('on', 'nothing') THEN silent ELSE 0 END,
    CASE how WHEN 'hard' THEN true WHEN 'on' THEN replay WHEN 'nothing' THEN replay ELSE false END, CASE WHEN how IN ('on', 'nothing') THEN quiet ELSE -1 END,
    CASE WHEN cut > 0 THEN start END, CASE WHEN cut > 0 THEN start + cut END, CASE WHEN cut > 0 THEN replay END
  FROM (SELECT *, CASE how WHEN 'pause' THEN size WHEN 'smart' THEN quiet WHEN 'hard' THEN size ELSE 0 END AS cut, CASE how WHEN 'on' THEN 0 WHEN 'smart' THEN quiet WHEN 'hard' THEN size - 8000 ELSE size END AS keep
    FROM (SELECT *, CASE WHEN spoken AND NOT speaking AND silent >= 11200 THEN 'pause' WHEN size < 80000 THEN 'on' WHEN NOT spoken THEN 'nothing' WHEN quiet >= size - 24000 AND quiet > 8000 THEN 'smart' ELSE 'hard' END AS how
      FROM (SELECT *, CASE WHEN speaking THEN 0 ELSE was + 512 END AS silent
        FROM (SELECT f.s, f.i, r.start, r.size + 512 AS size, CASE WHEN p >= 0.5 THEN true WHEN p < 0.35 THEN false ELSE speaking END AS speaking, spoken OR p >= 0.5 AS spoken, r.silent AS was, replay, CASE WHEN p < 0.35 THEN r.size + 512 ELSE quiet END AS quiet
          FROM run r JOIN frames f ON f.s = r.s AND f.i = r.i + 1))))),
-- what is left at the end closes if there is speech in it
rest AS (SELECT s, arg_max(start, i) AS start, arg_max(size, i) AS size, arg_max(spoken, i) AS spoken, arg_max(replay, i) AS replay, max(i) + 1 AS i FROM run GROUP BY s),
found AS (SELECT s, i, seg_start, seg_end, seg_replay FROM run WHERE seg_end IS NOT NULL UNION ALL SELECT s, i, start, start + size, replay FROM rest WHERE spoken AND size > 0)
SELECT s AS session_id, CAST(row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS INT) AS segment, CAST(seg_start AS BIGINT) AS start, CAST(seg_end AS BIGINT) AS "end", seg_replay AS replay FROM found"""
)
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented speech probabilities of the users' events, cut into segments."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    frames = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("win_no"), (F.sin(F.col("event_id") / 400.0) * 0.4 + 0.4 + k / 500.0).alias("probability"))
    return guards.segment_rows(frames)


# ------------------------------------------------------------------ event log

_LOG = """
WITH e AS (SELECT user_id AS session_id, event_id, ts, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS idx,
  CASE event_type WHEN 'purchase' THEN 'WORD_OK' WHEN 'view' THEN 'MISSED_WORD' WHEN 'click' THEN 'MISSED_AYAH' WHEN 'signup' THEN 'MUTASHABEH_JUMP' ELSE 'POSITION' END AS type,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
log AS (SELECT *, CASE idx % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'confirmed' ELSE 'revoked' END AS state, CASE WHEN idx % 3 = 2 THEN prev END AS refers_to FROM e),
kept AS (SELECT * FROM log WHERE type <> 'POSITION'),
gone AS (SELECT DISTINCT session_id, refers_to AS event_id FROM kept WHERE state = 'revoked'),
stands AS (SELECT * FROM kept WHERE state = 'confirmed' AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.session_id = kept.session_id AND gone.event_id = kept.event_id))"""
_COUNTS = """SELECT session_id, count(*) FILTER (type = 'WORD_OK') AS words_ok, count(*) FILTER (type = 'MISSED_WORD') AS words_missed, count(*) FILTER (type = 'MISSED_AYAH') AS ayahs_missed,
count(*) FILTER (type = 'MUTASHABEH_JUMP') AS jumps, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (type <> 'WORD_OK'), '') AS errors"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", "value", idx.alias("idx"),
        F.when(kind == "purchase", "WORD_OK").when(kind == "view", "MISSED_WORD").when(kind == "click", "MISSED_AYAH").when(kind == "signup", "MUTASHABEH_JUMP").otherwise("POSITION").alias("type"),
        F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("prev"),
    )
    state = F.when(F.col("idx") % 3 == 0, "provisional").when(F.col("idx") % 3 == 1, "confirmed").otherwise("revoked")
    return e.withColumn("state", state).withColumn("refers_to", F.when(F.col("idx") % 3 == 2, F.col("prev"))).drop("prev")


@query(f"{_LOG} {_COUNTS} FROM stands GROUP BY 1")
def summary_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary_live(sessions.persisted(event_log(spark, sf_dir)))


@query(f"{_LOG} {_COUNTS} FROM kept WHERE state = 'confirmed' GROUP BY 1")
def summary_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary_offline(sessions.persisted(event_log(spark, sf_dir)))


@query(f"{_LOG} {_COUNTS.replace('count(*) FILTER ' + chr(40) + 'type = ' + chr(39) + 'MISSED_WORD' + chr(39) + chr(41), '0::BIGINT')}, 'phoneme' AS mode FROM kept WHERE state = 'confirmed' GROUP BY 1")
def summary_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary_lines(sessions.persisted(event_log(spark, sf_dir)))


@query(
    f"""{_LOG}, s AS ({_COUNTS} FROM stands GROUP BY 1),
a AS (SELECT *, CASE WHEN words_ok + words_missed > 0 THEN CAST(floor(words_ok * 100.0 / (words_ok + words_missed) + 0.5) AS BIGINT) ELSE 0 END AS accuracy FROM s)
SELECT session_id, accuracy, CASE WHEN accuracy >= 90 THEN 'good' WHEN accuracy >= 70 THEN 'fair' ELSE 'poor' END AS band,
CASE WHEN words_ok + words_missed = 0 THEN 'empty' WHEN words_missed + ayahs_missed + jumps > 0 THEN 'issues' ELSE 'clean' END AS kind FROM a"""
)
def summary_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.accuracy(sessions.summary_live(sessions.persisted(event_log(spark, sf_dir))))


@query(f"{_LOG} SELECT type, state, count(*) AS n FROM log GROUP BY 1, 2")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.by_type_and_state(event_log(spark, sf_dir))


@query(f"{_LOG} SELECT session_id, max(idx) + 1 AS resume_at FROM log WHERE type = 'WORD_OK' AND state = 'confirmed' GROUP BY 1")
def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.resume_points(event_log(spark, sf_dir))


@query(
    f"""{_LOG},
log2 AS (SELECT session_id, event_id, idx, state, CASE WHEN type = 'MUTASHABEH_JUMP' AND idx % 4 = 0 THEN 'REPEAT' ELSE type END AS type FROM log WHERE idx IS NOT NULL),
d AS (SELECT *, CASE WHEN type = 'WORD_OK' THEN 'ok' WHEN state = 'provisional' THEN 'missed-provisional' WHEN state = 'confirmed' THEN 'missed' END AS status FROM log2 WHERE type IN ('WORD_OK', 'MISSED_WORD')),
b AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY session_id, idx ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
f AS (SELECT session_id, idx, arg_max(coalesce(status, 'none'), event_id) AS status, max(event_id) AS at FROM b WHERE status IS NOT NULL OR before IS DISTINCT FROM 'ok' GROUP BY 1, 2)
SELECT session_id, idx, status FROM f WHERE status <> 'none' AND NOT (status = 'missed-provisional' AND EXISTS (SELECT 1 FROM log2 r WHERE r.type = 'REPEAT' AND r.session_id = f.session_id AND r.idx < f.idx AND r.event_id > f.at))"""
)
def word_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return sessions.final_state(log.withColumn("type", F.when((F.col("type") == "MUTASHABEH_JUMP") & (F.col("idx") % 4 == 0), "REPEAT").otherwise(F.col("type"))))


@query(
    """WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 120000000 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY user_id ORDER BY us)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 120000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, island"""
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    w = guards.idle_windows(rows)
    return w.select(F.col("session_id").alias("user_id"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    """WITH r AS (SELECT user_id, event_id, sum(CAST(value * 100 AS BIGINT)) OVER w AS total, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 AS elapsed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CAST(total AS BIGINT) AS total, total > 0.01 * 1.1 * elapsed + 3.0 * 0.01 AS over FROM r"""
)
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("bytes"))
    r = guards.rate_limited(chunks, 0.01)
    return r.select(F.col("session_id").alias("user_id"), F.col("chunk").alias("event_id"), "total", "over")


@query("WITH f AS (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first FROM events) SELECT user_id, count(*) AS n FROM f WHERE epoch_us(ts) - epoch_us(first) <= 5400000000 GROUP BY 1")
def session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts")
    return guards.within_duration(rows).groupBy(F.col("session_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m) SELECT user_id, any_value(event_type) AS event_type, min(event_id) AS start, count(*) AS length FROM i GROUP BY user_id, island"""
)
def event_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.streaks(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(
    """WITH p AS (SELECT event_type, epoch_us(ts) AS moment, 1 AS d, 1 AS opens FROM events UNION ALL SELECT event_type, epoch_us(ts) + 300000000, -1, 0 FROM events),
o AS (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY moment RANGE UNBOUNDED PRECEDING) AS open FROM p) SELECT DISTINCT event_type, moment, CAST(open AS BIGINT) AS open FROM o WHERE opens = 1"""
)
def active_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("event_type", us.alias("s"), (us + 300_000_000).alias("e"))
    return sessions.gauge(spans, "event_type", "s", "e").withColumnRenamed("at", "moment")


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, max(CASE WHEN k = 1 THEN event_type END) AS leader, max(CASE WHEN k = 1 THEN n END) AS votes, coalesce(max(CASE WHEN k = 2 THEN n END), 0) AS second FROM r GROUP BY 1"""
)
def vote_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))).alias("l"))
    return ranked.select("user_id", F.get("l", F.lit(0))["event_type"].alias("leader"), (-F.get("l", F.lit(0))["m"]).alias("votes"), F.coalesce(-F.get("l", F.lit(1))["m"], F.lit(0).cast("bigint")).alias("second"))


# ------------------------------------------------------------------ relational operators


@query("SELECT o_orderkey AS id, o_custkey AS owner, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice BETWEEN 1000 AND 300000 AND o_orderpriority IS NOT NULL")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz '1996-01-01' and o_totalprice between 1000 and 300000 and o_orderpriority is not null")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"))


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    g = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return g.select("o_orderkey", "o_orderstatus", "n", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 30 DAY AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) OR o_custkey IS NULL"""
)
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    anonymous = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return sessions.purge(table(spark, sf_dir, "orders"), anonymous, "o_custkey", "o_orderdate", F.expr("timestamp_ntz '1998-08-01'")).select("o_orderkey", "o_custkey")


@query(
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), w AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT coalesce(w.k, o.k) AS k, coalesce(w.n, o.n) AS n, o.s AS s FROM o FULL JOIN w ON o.k = w.k"""
)
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cut = table(spark, sf_dir, "orders"), F.expr("timestamp_ntz '1996-01-01'")
    old = o.filter(F.col("o_orderdate") < cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("s"))
    new = o.filter(F.col("o_orderdate") >= cut).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.upsert(old, new, "k")


@query("SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS c_mktsegment FROM customer")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("c_mktsegment"))
    return sessions.update_latest(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "o_orderkey", "c_mktsegment")


@query(
    """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, max(CASE WHEN k = floor(n * 0.5) THEN o_totalprice END) AS median, max(CASE WHEN k = floor(n * 0.95) THEN o_totalprice END) AS p95, count(*) AS n FROM r GROUP BY 1"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


@query("SELECT l_returnflag, round(sum(l_discount), 2) AS took, round(sum(l_quantity), 2) AS duration, round(sum(l_discount) / sum(l_quantity), 8) AS rtf, round(avg(l_tax), 6) AS quality FROM lineitem GROUP BY 1")
def real_time_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sessions.real_time_factor(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", "l_quantity", "l_tax")
    return r.select("l_returnflag", F.round("took", 2).alias("took"), F.round("duration", 2).alias("duration"), F.round("rtf", 8).alias("rtf"), F.round("quality", 6).alias("quality"))


@query("SELECT o_orderkey, idx FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders) WHERE o_orderstatus = 'F'")
def sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index counts all rows of its sequence; rows are filtered after that."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("idx", (F.row_number().over(w) - 1).cast("bigint")).filter("o_orderstatus = 'F'").select("o_orderkey", "idx")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01')")
def builds_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz '1995-06-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sessions.missing(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, coalesce(n_name, 'Surah ' || c_nationkey) AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def labels_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("Surah "), F.col("c_nationkey").cast("string"))).alias("label"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000007') OR CAST(c_custkey AS VARCHAR) = 'r#00000007'")
def search_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(text.matches_query(" R#00000007 ", "c_name", "c_custkey")).select("c_custkey", "c_name")


@query(
    """SELECT l_orderkey, l_linenumber, printf('%03d%03d', l_orderkey % 1000, l_linenumber) AS code, l_orderkey || ':' || l_linenumber AS key, translate(CAST(l_linenumber AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits,
CAST(floor((l_linenumber - l_quantity) / 3.0) AS BIGINT) AS diagonal, round_even(l_quantity / 4, 0) AS band, CAST(floor(l_quantity / 60) AS BIGINT) AS minutes, CAST(floor(l_quantity) AS BIGINT) % 60 AS seconds,
least(8000.0, 1000.0 * pow(2, l_linenumber)) AS backoff, starts_with(l_linestatus, 'O') AS open FROM lineitem"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes, seconds = numeric.minutes_seconds("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.verse_code(F.col("l_orderkey") % 1000, "l_linenumber").alias("code"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        text.arabic_digits("l_linenumber").alias("digits"), numeric.floor_div(F.col("l_linenumber") - F.col("l_quantity"), 3).alias("diagonal"), numeric.half_even(F.col("l_quantity") / 4).alias("band"),
        minutes.alias("minutes"), seconds.alias("seconds"), numeric.backoff_ms("l_linenumber").alias("backoff"), F.col("l_linestatus").startswith("O").alias("open"),
    )


@query(
    """SELECT 'orders' AS "check", count(*) > 0 AS ok FROM orders UNION ALL SELECT 'no empty text', count(*) FILTER (text = '') = 0 FROM documents UNION ALL SELECT 'lines have orders', count(*) = 0 FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'line numbers start at 1', min(l_linenumber) = 1 FROM lineitem UNION ALL SELECT 'unique events', count(*) = count(DISTINCT event_id) FROM events"""
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    orphans = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return sessions.verify(
        {
            "orders": t("orders").agg((F.count(F.lit(1)) > 0).alias("ok")),
            "no empty text": t("documents").agg((F.count_if(F.col("text") == "") == 0).alias("ok")),
            "lines have orders": orphans.agg((F.count(F.lit(1)) == 0).alias("ok")),
            "line numbers start at 1": t("lineitem").agg((F.min("l_linenumber") == 1).alias("ok")),
            "unique events": t("events").agg((F.count(F.lit(1)) == F.count_distinct("event_id")).alias("ok")),
        }
    )
