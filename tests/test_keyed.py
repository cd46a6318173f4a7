"""The keyed table and the trigram index."""

import hashlib
import random
from pathlib import Path

import pytest

from quillstream.operators import keyed, substrings


def files(path):
    return {str(f): hashlib.md5(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet") if "/rows/" in str(f)}


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    r, want = random.Random(3), {}
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", "k long, n long, s string", buckets=16)
    assert t.read().count() == 0
    for batch in range(4):
        rows = {r.randrange(200): (r.choice([None, batch]), r.choice([None, f"b{batch}"])) for _ in range(120 if batch == 0 else 3)}
        before = files(tmp_path)
        df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "k long, n long, s string")
        touched = t.upsert(df, batch)
        for k, v in rows.items():
            old = want.get(k, (None, None))
            want[k] = tuple(a if a is not None else b for a, b in zip(v, old, strict=True))
        assert {x.k: (x.n, x.s) for x in t.read().collect()} == want and 0 < touched <= 16
        if batch:
            after = files(tmp_path)
            kept = {f for f in before if after.get(f) == before[f]}
            assert len({f.split("bucket=")[1].split("/")[0] for f in set(before) - kept}) <= touched <= 3
        # once more: nothing changes
        again = files(tmp_path)
        assert t.upsert(df, batch) == 0 and files(tmp_path) == again
    # a batch that broke off before its mark is run again and changes no row
    (tmp_path / "t" / "batches" / "batch=3" / "_SUCCESS").unlink()
    assert t.upsert(df, 3) and {x.k: (x.n, x.s) for x in t.read().collect()} == want
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, 1, "x")], "k long, n long, s string"), 9)
    assert t.upsert(df.limit(0), 10) == 0 and t.done(10)


def test_substring_index_prunes_and_loses_nothing(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    docs = [(i, None if i % 50 == 0 else " ".join(r.choice(words).title() for _ in range(5))) for i in range(2000)]
    asked = [(q, w) for q, w in enumerate([*r.sample(words, 20), words[5][:4].upper(), words[6][1:4], "ab", "Z", "not there", words[7] + " ", "é"])]
    df = spark.createDataFrame(docs, "id long, text string").repartition(4)
    queries = spark.createDataFrame(asked, "query int, literal string")
    found = substrings.index(df, "id", "text", 16)
    got = {tuple(x) for x in substrings.search(df, found, queries, "id", "text", 16).collect()}
    assert got == {(q, i) for q, w in asked for i, t in docs if t and w.lower() in t.lower()} and len(got) > 50
    # words of six letters open few of the 125 blocks
    every = df.select(substrings.block_of(df.id, 16).alias("block")).distinct()
    opened = substrings.blocks(found, queries.filter("query < 20"), every).count()
    assert opened < 0.3 * 20 * 125, opened
