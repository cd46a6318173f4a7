"""Operators against brute force, functions against plain Python, queries against SQL."""

import itertools
import json
import random
import re
import time
import unicodedata
from collections import defaultdict
from dataclasses import replace
from datetime import date

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.functions import numeric, register, similarity, text
from quillstream.operators import alignment, builds, corpus, pairs, requests, search, sessions
from quillstream.params import DEFAULT, Params
from quillstream.plans import catalogue
from quillstream.sources import readers
from quillstream.sources.session import prepare
from quillstream.streaming import guards, local_index
from quillstream.streaming import session as live
from quillstream.streaming.local_index import IdIndex
from quillstream.streaming.segmenter import Segmenter
from quillstream.streaming.tracker import match

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value as text, alike from both engines; lists and structs have no missing form."""
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


def plain_rows(df, cols):
    return sorted(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert plain_rows(got, cols) == plain_rows(want, cols)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio(spark):
    r = random.Random(1)
    ws = ["", "a", "ab", *("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(40))]
    both = [(a, b) for a, b in itertools.product(ws, ws[:15])]
    want = [200 * brute_lcs(a, b) / (len(a) + len(b)) if a + b else 100.0 for a, b in both]
    assert [similarity.ratio(a, b) for a, b in both] == want
    df = prepare(spark).createDataFrame([(i, a, b) for i, (a, b) in enumerate(both)], "i int, a string, b string")
    got = df.select("i", similarity.ratio_expr("a", "b").alias("x"), similarity.ratio_udf("a", "b").alias("y")).orderBy("i").collect()
    assert [x.x for x in got] == pytest.approx(want) and [x.y for x in got] == pytest.approx(want)
    register(spark)
    assert spark.sql("SELECT lcs_ratio('abc', 'abd') AS r").first().r == pytest.approx(200 * 2 / 6)


def test_id_distance(spark):
    r = random.Random(2)
    rows = [([r.randint(1, 38) for _ in range(r.randint(0, 8))], [r.randint(1, 38) for _ in range(r.randint(0, 8))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<int>, b array<int>")
    got = [x.d for x in df.select("i", similarity.id_distance_expr(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == pytest.approx([similarity.id_distance(a, b) for a, b in rows])
    assert similarity.covered([1, 2, 3, 4, 5, 6, 7, 8, 9], [4, 5, 6]) == 0.0 and similarity.covered([1], []) == 1.0


def test_arabic_form(spark):
    r = random.Random(3)
    pool = "ءآأؤإئابةتىيٱًّـٰۖ \t xZ9،"
    texts = ["", None, *("".join(r.choice(pool) for _ in range(r.randint(0, 15))) for _ in range(300))]

    def want(t):
        t = unicodedata.normalize("NFC", t or "")
        t = re.sub("[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭـ]", "", t)
        t = t.translate(str.maketrans("آأإٱؤئىة", "ااااوييه"))
        return re.sub(r"[^ء-ي\s]", "", t).split()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.tokens("t", "arabic").alias("w")).orderBy("i").collect()
    assert [x.w for x in got] == [want(t) for t in texts]


def test_numeric(spark):
    row = spark.sql("SELECT -1 AS a, array(0.5D, -2.0D) AS f, array(0, 1, 1, 0, 1, 2, 2) AS ids, array(array(0.1D, 0.9D), array(0.7D, 0.2D)) AS logits").select(
        numeric.floor_div("a", 3).alias("d"), numeric.float_to_pcm(F.col("f")).alias("pcm"), numeric.rms(F.col("f")).alias("rms"), numeric.collapse(F.col("ids")).alias("c"),
        numeric.argmax_ids(F.col("logits")).alias("am"), numeric.resample(F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0))), 2, 1).alias("r"), numeric.half_up(F.lit(2.5)).alias("u"), numeric.half_even(F.lit(2.5)).alias("e"),
        numeric.level(F.lit(0.5), F.lit(False)).alias("l"), numeric.pcm_to_float(F.array(F.lit(16384))).alias("p"),
    ).first()
    assert (row.d, row.pcm, row.c, row.am, row.r, row.u, row.e, row.l, row.p) == (-1, [16384, -32767], [1, 1, 2], [1, 0], [0.0, 2.0], 3, 2.0, 1.0, [0.5])
    assert row.rms == pytest.approx((4.25 / 2) ** 0.5)


LINES = ["the cat sat on the mat", "a dog ran over the hill and far", "", "the cat sat on the rug", "one two three four five six"]


def small(spark, profile="letters"):
    docs = spark.createDataFrame([(1, "\n".join(LINES[:3])), (2, "\n".join(LINES[3:])), (3, None), (4, "")], "doc_id long, text string")
    return corpus.passages(docs, profile=profile)


def index_of(parts):
    return local_index.from_words(corpus.words(parts))


def test_searches_equal_local_index(spark):
    parts = small(spark)
    index = index_of(parts)
    asked = [["the", "cat", "sat", "on", "the"], ["zz", "dog", "ran", "over", "the", "hill"], ["kat", "satt", "on", "the"], ["nothing", "here", "matches", "qq"], ["one"], []]
    q = spark.createDataFrame(list(enumerate(asked)), "query int, tokens array<string>")
    for batch, single in ((search.relocation, index.search), (search.location, index.search_words)):
        got = defaultdict(list)
        for r in batch(parts, q).orderBy("query", "rank").collect():
            got[r.query].append((r.passage, r.line_no, round(r.score, 6)))
        for i, t in enumerate(asked):
            want = [(p, n, round(s, 6)) for _, p, n, s in (single(t) if t else [])]
            assert sorted(got[i]) == sorted(want), (batch, t)


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    vocab = ["w%s" % "".join(r.choice("abcdef") for _ in range(4)) for _ in range(60)]
    base = [[r.choice(vocab) for _ in range(r.randint(4, 16))] for _ in range(12)]
    lines = base + [[w if r.random() > 0.15 else r.choice(vocab) for w in b] for b in base]
    docs = spark.createDataFrame([(7, "\n".join(" ".join(re.sub("[0-9]", "", w) for w in x) for x in lines))], "doc_id long, text string")
    got = {(tuple(x.source), tuple(x.target)): x.score for x in pairs.similar_pairs(corpus.passages(docs)).collect()}
    g = [{tuple(x[i : i + 3]): i for i in reversed(range(len(x) - 2))} for x in lines]
    want = {}
    for a, b in itertools.combinations(range(len(lines)), 2):
        s = max((similarity.ratio(" ".join(lines[a][g[a][k] : g[a][k] + 10]), " ".join(lines[b][g[b][k] : g[b][k] + 10])) for k in g[a].keys() & g[b].keys()), default=0)
        if s >= 72:
            want[(7, a + 1), (7, b + 1)] = want[(7, b + 1), (7, a + 1)] = round(s / 100, 4)
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) <= 1e-4 for k in want)


def test_alignment_equals_match(spark):
    parts = small(spark)
    reference = index_of(parts).reference(1)
    said = "the kat sat mat on the hill zzz dgo far".split()
    tokens = spark.createDataFrame([(0, i, t, 1, i) for i, t in enumerate(said)], "key int, i int, token string, passage long, pointer int")
    got = {r.i: (r.pos, round(r.score, 6)) for r in alignment.align(tokens, corpus.words(parts)).collect()}
    want = {i: (m[0], round(m[1], 6)) for i, t in enumerate(said) if (m := match(t, reference, i))}
    assert got == want


def test_small_kernels(spark):
    df = spark.createDataFrame([(["a", "x", "b"], ["a", "b", "c"]), ([], []), (["b", "a"], ["a", "b"])], "h array<string>, w array<string>")
    assert [round(r.x, 4) for r in df.select(alignment.in_order_accuracy("h", "w").alias("x")).collect()] == [0.6667, 0.0, 0.5]
    seq = spark.createDataFrame([(1, [[1, 2, 3, 4], [1, 2, 3, 9]]), (2, [[1, 2], None]), (3, [None, None])], "item int, sources array<array<int>>")
    assert {r.item: (r.confidence, r.unstable) for r in alignment.agreement(seq).collect()} == {1: (0.75, False), 2: (0.0, True)}
    st = spark.createDataFrame([([1, 2, 3, 4, 5, 6, 7, 50, 51, 52], [1, 2, 3, 4, 5, 6, 7]), ([9] * 10, [1, 2, 3, 4, 5, 6, 7])], "x array<int>, t array<int>")
    assert [r.y for r in st.select(alignment.strip_template("x", "t").alias("y")).collect()] == [[50, 51, 52], [9] * 10]


def client(events):
    """What a client shows, one event after the other."""
    words, first = {}, {}
    for e in events:
        if e.type == "WORD_OK":
            words[e.idx] = "ok"
        elif e.type == "MISSED_WORD":
            if e.state == "revoked":
                if words.get(e.idx, "").startswith("missed"):
                    del words[e.idx]
            else:
                words[e.idx] = "missed" if e.state == "confirmed" else "missed-provisional"
        elif e.type == "REPEAT":
            words = {k: v for k, v in words.items() if not (k > e.idx and v == "missed-provisional")}
    return words


def test_final_state_equals_fold(spark):
    r = random.Random(8)
    rows = [(s, i, r.choice(["WORD_OK", "MISSED_WORD", "MISSED_WORD", "REPEAT"]), r.choice(["provisional", "confirmed", "revoked"]), r.randint(0, 6)) for s in range(30) for i in range(25)]
    df = spark.createDataFrame(rows, "session_id int, event_id int, type string, state string, idx int")
    got = defaultdict(dict)
    for x in sessions.final_state(df).collect():
        got[x.session_id][x.idx] = x.status
    by = defaultdict(list)
    for x in df.orderBy("session_id", "event_id").collect():
        by[x.session_id].append(x)
    assert all(got[s] == client(v) for s, v in by.items())


def test_guards(spark):
    asked = [("open", "a", "1"), ("open", "a", "1"), ("open", "b", "1"), ("open", "c", "1"), ("open", "d", "2"), ("open", "e", "3"), ("end", "a", "1"), ("open", "e", "3")]
    rows = spark.createDataFrame([("s", i, float(i), *x) for i, x in enumerate(asked)], "server string, seq long, at double, action string, session string, address string").repartition(3)
    got = [(x.session, x.outcome) for x in guards.admit(rows).orderBy("seq").collect()]
    assert got == [("a", "admitted"), ("a", "duplicate"), ("b", "admitted"), ("c", "address full"), ("d", "admitted"), ("e", "server full"), ("e", "admitted")]
    t = spark.createDataFrame([("x", 0.1, -0.1, 1.0, 1.0), ("y", 0.9, -0.1, 1.0, 1.0), ("", 0.1, -0.1, 1.0, 1.0), ("z", 0.1, -0.1, 1.0, 0.3)], "text string, no_speech_prob double, avg_logprob double, compression_ratio double, seconds double")
    assert {x.text: x.gated for x in sessions.gate(t).collect()} == {"x": False, "y": True, "": True, "z": True}


def test_admission_on_a_stream(spark, tmp_path):
    """Rejects equal a replay by hand, over two micro-batches; leases that nobody gives back expire and
    leave no state."""
    r, now = random.Random(9), time.time()
    asked = [(f"v{r.randrange(4)}", i, r.choice(["open", "open", "end"]), f"s{r.randrange(9)}", f"a{r.randrange(3)}") for i in range(400)]
    rows = [(v, i, now - 40_000 + i * 40.0, *x) for v, i, *x in asked]
    want, held = [], defaultdict(dict)
    for server, seq, at, action, session, address in rows:
        mine = held[server] = {k: v for k, v in held[server].items() if v[1] > at}
        if action == "end":
            mine.pop(session, None)
            continue
        full = [len(mine) >= 3, sum(a == address for a, _ in mine.values()) >= 2]
        outcome = "duplicate" if session in mine else "server full" if full[0] else "address full" if full[1] else "admitted"
        if outcome == "admitted":
            mine[session] = (address, at + 5400)
        want.append((server, seq, session, outcome))
    ddl = "server string, seq long, at double, action string, session string, address string"
    df = prepare(spark).createDataFrame(rows, ddl)
    assert sorted(map(tuple, guards.admit(df.repartition(4)).collect())) == sorted(want) and {x[3] for x in want} == {"admitted", "duplicate", "server full", "address full"}
    start = lambda name, df: guards.admit_stream(df).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
    # leases that last: two micro-batches tell what one does
    fresh = df.withColumn("at", F.lit(now) + F.col("seq") / 100)
    for low in (0, 200):
        fresh.filter((F.col("seq") >= low) & (F.col("seq") < low + 200)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start("admitted", stream).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, guards.admit(fresh).collect()))
    # leases of long ago: one batch, then timers
    df.coalesce(1).write.parquet(str(tmp_path / "old"))
    q = start("expired", spark.readStream.schema(ddl).parquet(str(tmp_path / "old"))).trigger(processingTime="500 milliseconds").start()
    try:
        rest = lambda: q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsTotal"]
        for _ in range(120):
            if spark.table("expired").count() >= len(want) and rest() == 0:
                break
            time.sleep(0.5)
        assert sorted(map(tuple, spark.table("expired").collect())) == sorted(want) and rest() == 0
    finally:
        q.stop()


def test_runs_cross_the_borders_of_stretches(spark):
    r = random.Random(10)
    rows = [(k, i, r.choice("abc")) for k in range(3) for i in range(r.choice([1, 2, 50, 131]))]
    df = spark.createDataFrame(rows, "k int, i int, w string").repartition(5)
    for n, stretch in ((3, 0), (3, 2), (4, 10), (2, 1)):
        want = sorted((k, i, " ".join(ws)) for k in range(3) for i, ws in enumerate(zip(*([w for q, _, w in rows if q == k][j:] for j in range(n)), strict=False)))
        if stretch >= n - 1:
            assert sorted(tuple(x) for x in corpus.runs(df, ["k"], "i", "w", n, stretch=stretch).select("k", "i", "gram").collect()) == want
        else:
            assert sorted(tuple(x) for x in corpus.runs(df, ["k"], "i", "w", n).select("k", "i", "gram").collect()) == want


def test_edit_distance_by_bits():
    r = random.Random(11)
    for _ in range(500):
        a, b = ([r.randrange(r.choice([2, 6, 300])) for _ in range(r.randint(0, 90))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert similarity.edit_distance(a, b) == similarity.Pattern(a).distance(b) == row[-1]


def test_segmenter():
    frames = lambda s: round(s * 16000 / 512)
    run = lambda seg, ps: [x for p in ps if (x := seg.frame(p))]
    assert run(Segmenter(), [0.0] * frames(20)) == []
    one = run(Segmenter(), [0.9] * frames(1) + [0.0] * frames(1))
    assert len(one) == 1 and not one[0][2] and one[0][1] - one[0][0] == (frames(1) + 22) * 512
    hard = run(Segmenter(), [0.9] * frames(11))
    assert [x[2] for x in hard] == [False, True] and hard[1][0] == hard[0][1] - 8000
    smart = run(Segmenter(), [0.9] * frames(4) + [0.1] * 3 + [0.9] * frames(1))
    assert not smart[0][2] and smart[0][1] == (frames(4) + 3) * 512
    s = Segmenter()
    assert s.flush() is None and s.frame(0.9) is None and s.flush() == (0, 512, False)


def test_stream_equals_batch(spark, tmp_path):
    rows = catalogue.session_rows(prepare(spark), SF).filter("session_id < '3'")
    want = sorted(map(tuple, live.track_batch(rows).collect()))
    for k in range(2):
        rows.filter(F.col("seq") < 2001 if k == 0 else F.col("seq") >= 2001).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.ROWS_DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.track_stream(stream).writeStream.foreachBatch(readers.append_events(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(map(tuple, got)) == [x for x in want if x[3] not in ("POSITION", "ENDED")] and got


def test_sessions_are_folded_once_and_row_by_row(spark):
    """A report's plan holds no fold; the fold holds no session as a frame, and equals one that does."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    report = catalogue.session_reports(prepare(spark), SF)
    assert "MapInArrow" not in plan(report) and "InPandas" not in plan(report) and report.count()
    rows = catalogue.session_rows(prepare(spark), SF).filter("session_id < '3'")
    found = live.track_batch(rows.orderBy(F.rand(3)))
    assert "InPandas" not in plan(found)
    want = [tuple(None if pd.isna(x) else x for x in r) for sid, f in rows.toPandas().groupby("session_id") for r in live.fold(live.Session(), sid, f).itertuples(index=False)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and len(want) > 100


def test_idle_sessions_end_and_leave_no_state(spark, tmp_path):
    """Timers end a session that says nothing more; its state goes, and later rows are ignored."""
    rows = catalogue.session_rows(prepare(spark), SF).filter("session_id < '2' and kind <> 'end'")
    rows.filter("seq < 2001").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.ROWS_DDL).parquet(str(tmp_path / "in"))
    soon = replace(DEFAULT, idle_seconds=2)
    q = live.track_stream(stream, p=soon).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            ended = [r for r in spark.table("idle").filter("type = 'ENDED'").collect()]
            if ended and len(ended) == rows.select("session_id").distinct().count():
                break
            time.sleep(0.5)
        assert ended and {json.loads(r.payload)["reason"] for r in ended} == {"idle timeout"}
        assert len({r.session_id for r in ended}) == len(ended) == rows.select("session_id").distinct().count()
        time.sleep(2)
        kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert kept == 0
    finally:
        q.stop()


def test_clock_ends_sessions():
    ref = [[i, 2, 1, 9, i + 1, w] for i, w in enumerate("bisak talomi verand hamdu".split())]
    def session(**p):
        s = live.Session(p=replace(DEFAULT, **p))
        s.row("open", {"reference": ref, "opening": False, "at": 0})
        return s

    say = lambda s, at, n=0: [e["payload"].get("reason") for e in s.row("tokens", {"tokens": ["bisak"], "at": at, "bytes": n}) if e["type"] == "ENDED"]
    s = session(idle_seconds=10, session_minutes=1)
    assert [say(s, t) for t in (5, 15, 25, 36, 37)] == [[], [], [], ["idle timeout"], []]
    s = session(session_minutes=1)
    assert [say(s, t) for t in (30, 60, 61)] == [[], [], ["max duration"]]
    s = session(bytes_per_second=10)
    assert [say(s, t, n) for t, n in ((0, 30), (1, 11), (2, 12))] == [[], [], ["rate limit"]]
    s = session()
    assert s.row("resume", {"idx": 99})[0]["payload"] == {"idx": 4} and s.row("reposition", {"idx": -3})[0]["payload"] == {"idx": 0}
    assert [e["payload"] for e in s.row("end", {})] == [{"reason": "user"}] and s.row("end", {}) == []


def test_id_sessions(spark, tmp_path):
    """Id windows through batch and stream: progress, a skipped line, a repeat, a detour."""
    r = random.Random(4)
    lines = [(p * 100 + i, p, i, [r.randint(1, 38) for _ in range(r.randint(12, 25))], (p, i) == (2, 5), 4) for p in (1, 2, 3) for i in range(1, 9)]
    index = IdIndex(lines)
    assert [x.number for x in index.reference(2, 3)] == [3, 4, 6, 7, 8] and index.reference(2, 3)[2].words[0]["idx"] == 12
    ids = {x[0]: x[3] for x in lines}
    assert index.vote(ids[203])[0] == (203, 2, 3, 1.0) and index.vote([1, 2]) == [] and index.vote(ids[205]) == [] or index.vote(ids[205])[0][3] < 0.5
    script = {"a": [201, 202, 204, 203, 204], "b": [301, 302, 101, 101, 303]}
    rows = [(k, 0, "open", json.dumps({"passage": 2 if k == "a" else 3, "ids": True})) for k in script]
    rows += [(k, n, "ids", json.dumps({"ids": ids[x]})) for k, xs in script.items() for n, x in enumerate(xs, 1)]
    rows += [("auto", 0, "open", json.dumps({"auto": True, "ids": True}))] + [("auto", n, "ids", json.dumps({"ids": ids[x]})) for n, x in enumerate((103, 104, 105), 1)] + [(k, 9, "end", "{}") for k in "ab"]
    df = prepare(spark).createDataFrame(rows, live.ROWS_DDL)
    got = sorted(map(tuple, live.track_batch(df, None, index).collect()))
    kinds = lambda k: [(x[3], x[4]) for x in got if x[0] == k and x[3] not in ("WORD_OK", "POSITION")]
    assert kinds("a") == [("MISSED_AYAH", "confirmed"), ("REPEAT", "confirmed"), ("ENDED", "confirmed")]
    assert sorted(kinds("b")) == [("ENDED", "confirmed"), ("MUTASHABEH_JUMP", "confirmed"), ("MUTASHABEH_JUMP", "provisional")]
    assert [x[3] for x in got if x[0] == "auto" and x[3].startswith("DETECT")] == ["DETECTING", "DETECTED"]
    # from a line before the earliest match, and both windows heard so far replayed
    assert json.loads(next(x[5] for x in got if x[3] == "DETECTED"))["ayah"] == 2
    assert sum(x[0] == "auto" and x[3] == "WORD_OK" for x in got) == 12
    df.filter("seq < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("seq >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.segment_stream(spark, str(tmp_path / "in"), most=1)
    q = live.track_stream(stream, None, index).writeStream.format("memory").queryName("ids").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("ids").collect())) == got


def test_auto_detection(spark):
    index = index_of(small(spark))
    s = live.Session(index)
    s.row("open", {"auto": True})
    assert [e["type"] for e in s.row("tokens", {"tokens": ["the"]})] == ["DETECTING"]
    ev = s.row("tokens", {"tokens": "dog ran over the hill and far".split()})
    assert s.state["phase"] == "tracking" and sum(e["type"] == "WORD_OK" for e in ev) >= 6
    assert [e["type"] for e in s.row("end", {})] == ["ENDED"] and s.row("tokens", {"tokens": ["the"]}) == []


def test_sources(spark, tmp_path):
    page = {"verses": [{"id": 1, "verse_key": "1:1", "words": [{"id": 10, "char_type_name": "word", "text_uthmani": "بِسْمِ", "text_imlaei": ""}, {"id": 11, "char_type_name": "end", "text_uthmani": "x", "text_imlaei": "x"}, {"id": 12, "char_type_name": "word", "text_uthmani": "u", "text_imlaei": "اللَّهِ"}]}]}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    rows = corpus.flatten_verses(readers.read_pages(spark, str(tmp_path / "p1.json"))).orderBy("position").collect()
    assert [(r.id, r.position, r.text_normalized) for r in rows] == [(10, 1, "بسم"), (12, 2, "الله")]
    bodies = {1: {"pagination": {"next_page": 2}}, 2: {"pagination": {"next_page": None}}}
    assert list(readers.paged(bodies.get)) == [bodies[1], bodies[2]]
    waits, answers = [], iter([OSError(), OSError(), "ok"])

    def get():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert readers.with_retry(get, wait=waits.append) == "ok" and waits == [1.0, 2.0]
    (tmp_path / "a.wav").write_bytes(readers.encode_wav([0.0, 1.0, -2.0] * 2000))
    wav = readers.read_wav(spark, str(tmp_path / "a.wav")).orderBy("chunk").collect()
    assert [len(r.samples) for r in wav] == [4000, 2000] and wav[0].samples[:3] == [0, 32767, -32767]
    with pytest.raises(ValueError):
        readers.decode_wav(b"RIFFxxxxWAVE", 16000)
    assert readers.snapshots_to_drop(["2024-01-01", "2024-01-20"], date(2024, 1, 21)) == ["2024-01-01"]
    for f in range(2):
        spark.sparkContext  # noqa: B018
        (tmp_path / f"http{f}.json").write_text(json.dumps(bodies[2]))
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("paged").option("url", f"file://{tmp_path}/http0.json").option("chapters", 2).load().collect()
    assert sorted((r.chapter, r.page) for r in got) == [(1, 1), (2, 1)]


def test_schema_and_params(spark):
    old = spark.createDataFrame([(1, 2, 3)], "id int, surah_id int, number int")
    assert schemas.evolve(old, "ayahs").columns == schemas.COLUMNS["ayahs"] and schemas.empty(spark, "events").count() == 0
    assert Params.from_env({"QUILLSTREAM_CONFIRM_AFTER": "5", "QUILLSTREAM_DETECT_MARGIN": "0.3"}).confirm_after == 5
    words = spark.createDataFrame([(1, 10, 1, "a", "a", "a"), (2, 11, 1, "b", "b", "b"), (3, 10, 2, "c", "c", "c")], schemas.schema("words"))
    lines = spark.createDataFrame([(10, 2, 5), (11, 2, 4)], "id int, surah_id int, number int")
    assert [(r.idx, r.norm) for r in corpus.reference_from(words, lines, 2, 5).orderBy("idx").collect()] == [(0, "a"), (1, "c")]
    assert [[w.text for w in r.words] for r in corpus.nested_text(words, lines).orderBy("number").collect()] == [["b"], ["a", "c"]]
    p = spark.createDataFrame([(1, 2)], "source int, target int")
    assert [r.found for r in pairs.pair_known(p, spark.createDataFrame([(1, 2), (2, 1)], "source int, target int")).orderBy("source").collect()] == [True, False]


def test_live_audio_and_snapshots(spark, tmp_path):
    for name, n in (("a", 1), ("a", 2), ("b", 1)):
        (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name / f"{n}.pcm").write_bytes(b"\x01\x00\xff\xff" * n + b"\x07")
    q = readers.audio_stream(prepare(spark), str(tmp_path / "in"), most=1).writeStream.format("memory").queryName("audio").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.seq): (r.bytes, list(r.samples)) for r in spark.table("audio").collect()}
    assert got == {("a", 1): (5, [1, -1]), ("a", 2): (9, [1, -1, 1, -1]), ("b", 1): (5, [1, -1])}
    df = spark.range(3)
    assert readers.snapshot(df, str(tmp_path / "s"), date(2024, 1, 21), ["2024-01-01", "2024-01-20"]) == ["2024-01-01"]
    readers.snapshot(df, str(tmp_path / "s"), date(2024, 1, 21), [])
    assert spark.read.parquet(str(tmp_path / "s" / "2024-01-21")).count() == 3
    readers.reload(df, str(tmp_path / "r"))
    readers.reload(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    both = spark.createDataFrame([("x", "y"), (None, "z")], "cloud string, own string")
    assert [r.text for r in readers.transcripts(both, "cloud", "own").collect()] == ["x", "z"]
    message = json.loads(readers.as_messages(spark.createDataFrame([("s", 1, "REPEAT", "confirmed", "{}", None)], "session_id string, event_id long, type string, state string, payload string, refers_to long"), asr_ms=12).first().message)
    assert message == {"event_id": 1, "type": "REPEAT", "state": "confirmed", "payload": "{}", "asr_ms": 12}


def test_contracts(spark):
    assert schemas.lacks(schemas.empty(spark, "transcripts"), "transcripts") == []
    assert schemas.lacks(spark.createDataFrame([("a", 1, 2)], "session_id string, seq long, ids int"), "id_windows") == ["seq", "ids"]


def test_arabic_form_of_composed_and_decomposed_text(spark):
    """NFC is left out: for every letter and mark, composed or not, the matching form is the same."""
    base = [chr(c) for c in range(0x0600, 0x0700)]
    texts = [f"ب{x}{m}ت" for x in base for m in ("", "\u0653", "\u0654", "\u0655", "\u064b")]
    df = spark.createDataFrame([(t, unicodedata.normalize("NFC", t), unicodedata.normalize("NFD", t)) for t in texts], "a string, b string, c string")
    assert df.filter((text.arabic("a") != text.arabic("b")) | (text.arabic("a") != text.arabic("c"))).count() == 0


def test_builds_and_requests(spark):
    items = spark.createDataFrame([(i, i % 2) for i in range(130)], "k int, surah int")
    got = builds.next_builds(items, items.filter("k < 20"), "k", 70, surah=1).collect()
    assert [r.k for r in got] == list(range(21, 130, 2)) and [r.commit for r in got] == [0] * 50 + [1] * 5
    assert builds.next_builds(items, items, "k", 5, force=True, surah=None).count() == 5 and builds.next_builds(items, items, "k", 5).count() == 0
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert builds.same_rows(a, a.orderBy("x")).first().same and not builds.same_rows(a, a.distinct()).first().same
    df = spark.createDataFrame([("123E4567-e89b-12d3-a456-426614174000", '{"errors": ["x"]}'), ("123E4567", "{}"), (None, None)], "u string, d string")
    assert [(r.u, r.e) for r in df.select(requests.parse_uuid("u").alias("u"), requests.errors_of("d").alias("e")).collect()] == [("123e4567-e89b-12d3-a456-426614174000", ["x"]), (None, []), (None, [])]
