"""Pairs of lines on chunks of numbered words: against SQL on odd names, and what is kept on disk."""

import random
from pathlib import Path

import duckdb
import pandas as pd

from quillstream.operators import corpus, line_pairs, pairs
from quillstream.plans import catalogue
from quillstream.sources.session import shared_dir


def documents(n, seed=23):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgö") for _ in range(r.randint(1, 7))) for _ in range(400)]
    lines = [[r.choice(vocabulary) for _ in range(r.randint(0, 30))] for _ in range(n)]
    lines += [[w if r.random() > 0.1 else r.choice(vocabulary) for w in r.choice(lines)] for _ in range(n)] + r.choices(lines, k=n // 3)
    return [(k, "\n".join(map(" ".join, r.choices(lines, k=r.randint(1, 9))))) for k in range(n)]


def test_pairs_equal_sql_on_unknown_and_repeated_names(spark, tmp_path):
    docs = documents(60)
    docs += [(None, docs[5][1]), (7, docs[7][1]), (90, docs[7][1]), (91, None), (92, "")]  # a copy without a name, a row twice
    frame = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    frame.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(catalogue.ORACLES["similar_pairs"]).fetchall()
    got = list(map(tuple, catalogue.similar_pairs(spark, str(tmp_path)).collect()))
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_pairs_in_small_chunks_and_lots(spark, monkeypatch):
    docs = spark.createDataFrame(documents(60), "doc_id long, text string").repartition(3)
    want = set(map(tuple, pairs.similar_pairs(corpus.passages(docs)).collect()))
    monkeypatch.setattr(line_pairs, "_PER_TASK", 50)  # many tasks a pass
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert want == set(map(tuple, pairs.similar_pairs(corpus.passages(docs)).collect())) and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # lots of pairs that are scored at once are cut between grams
    alone = [line_pairs._alike(g, t, b, 72.0) for g, t, b in cut(9)]
    assert sum(len(x[0]) for x in alone) == len(line_pairs._alike(*whole(9), 72.0)[0])


def whole(n):
    import numpy as np

    texts = [f"w{g} x y z{'abc'[k]}" for g in range(n) for k in range(3)]
    return np.repeat(np.arange(n), 3), texts, np.zeros(3 * n, bool)


def cut(n):
    group, texts, back = whole(n)
    for g in range(n):
        own = group == g
        yield group[own], [t for t, k in zip(texts, own, strict=True) if k], back[own]


def test_pairs_leave_no_windows_on_disk(spark):
    r = random.Random(29)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(5000)]
    docs = [(k, "\n".join(" ".join(r.choices(vocabulary, k=25)) for _ in range(10))) for k in range(300)] + [(300, " ".join(vocabulary[:25])), (301, " ".join(vocabulary[:25]))]
    home = Path(shared_dir(spark).removeprefix("file://"))
    size = lambda: sum(f.stat().st_size for f in home.rglob("*.parquet"))
    before = size()
    found = pairs.similar_pairs(corpus.passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found.limit(1).count() and size() - before < sum(len(t) for _, t in docs)
