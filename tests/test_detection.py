"""Detection against the distributed corpus, against the locator inside a task."""

import json
import random

from pyspark.sql import functions as F

from quillstream.operators import corpus
from quillstream.params import OPENINGS
from quillstream.streaming import detection, local_index
from quillstream.streaming import session as live
from quillstream.streaming.locator import Locator


def corpus_and_sessions(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 8)))
    refrain = [word() for _ in range(6)]
    docs = []
    for d in range(1, 7):
        lines = [[word() for _ in range(r.randint(3, 7))] for _ in range(25)]
        for k in range(2, 25, 5):
            lines[k] = refrain
        docs.append((d, "\n".join(" ".join(x) for x in lines)))
    rows = []
    for s in range(30):
        text = docs[r.randrange(6)][1].split()
        at = r.randrange(len(text) - 40)
        said = text[at : at + 30] if s % 5 else [word() for _ in range(20)]
        if s % 5 == 1:
            said = refrain[:4] + text[at : at + 12]
        if s % 3 == 0:
            said = [w[:-1] + "z" if r.random() < 0.3 else w for w in said]
        if s % 4 == 0:
            said = [w for _, ws in OPENINGS[s % 2 :] for w in ws] + said
        seq = 0
        while said:
            seq += 1
            n = r.randint(0, 5)
            rows.append((f"s{s}", seq, said[:n]))
            said = said[n:]
    parts = corpus.passages(spark.createDataFrame(docs, "doc_id long, text string"))
    return parts, rows


def by_locator(index, rows):
    out = {}
    for s in sorted({x[0] for x in rows}):
        locator = Locator(index.search_words)
        for _, seq, tokens in sorted(x for x in rows if x[0] == s):
            if (hit := locator.feed(list(tokens))) is not None:
                out[s] = (seq, hit[1], hit[2], round(hit[3], 9), list(locator.window))
                break
    return out


def test_locks_and_tracks(spark, tmp_path):
    parts, rows = corpus_and_sessions(spark)
    index = local_index.from_words(corpus.words(parts))
    want = by_locator(index, rows)
    df = spark.createDataFrame(rows, "session_id string, seq int, tokens array<string>").repartition(3)
    found = detection.locks(df, parts)
    got = {x.session_id: (x.seq, x.passage, x.line_no, round(x.score, 9), list(x.window)) for x in found.collect()}
    assert got == want and 15 < len(want) < 30
    assert detection.locks(df.limit(0), parts).count() == 0
    # from the lock on, events are those of a session that detects inside a task
    auto = [(s, 0, "open", json.dumps({"auto": True})) for s in want] + [(s, q, "tokens", json.dumps({"tokens": t})) for s, q, t in rows if s in want]
    folded = live.track_batch(spark.createDataFrame(auto, live.ROWS_DDL), index).filter("event_id > 0")
    keys = ["session_id", "seq", "event_id", "type", "state", F.get_json_object("payload", "$.idx").alias("idx"), F.get_json_object("payload", "$.ayah").alias("ayah"), "refers_to"]
    # (but for jumps, which need a search of every stray tail)
    jumped = {x.session_id for x in folded.filter("type = 'MUTASHABEH_JUMP'").select("session_id").collect()}
    plain = lambda d: sorted((tuple(x) for x in d.select(*keys).collect() if x.session_id not in jumped), key=str)
    assert plain(detection.tracked(df, found, parts).filter("event_id > 0")) == plain(folded) and len(jumped) < 8
    # the same rows as three micro-batches, one of them run twice
    handler = detection.OnStream(parts, str(tmp_path))
    for batch, (low, high) in enumerate([(0, 3), (3, 5), (5, 99)]):
        for _ in range(2 if batch == 1 else 1):
            handler(df.filter((F.col("seq") > low) & (F.col("seq") <= high)), batch)
    streamed = spark.read.parquet(f"{tmp_path}/locks").collect()
    assert {x.session_id: (x.seq, x.passage, x.line_no, round(x.score, 9), list(x.window)) for x in streamed} == want
    assert not {x.session_id for x in spark.read.parquet(f"{tmp_path}/open/batch=2").collect()} & set(want)
