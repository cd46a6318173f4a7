"""What searches read once, and count or look through inside tasks, against plain Python."""

import random
from collections import Counter

import pyarrow as pa

from quillstream.operators import search, substrings
from quillstream.sources.session import prepare


def test_vocabulary_of_counts_inside_tasks(spark, monkeypatch):
    r = random.Random(15)
    rows = [(k, [[r.choice("ab cd é öx longer".split()) for _ in range(r.randint(0, 6))] for _ in range(r.randint(0, 4))]) for k in range(50)]
    rows += [(None, [["null", "ab"]]), (99, [["once", "null", "once"]])]
    r.shuffle(rows)
    counts, first = Counter(), {}
    for k, lines in rows:
        for at, w in enumerate(w for ws in lines for w in ws):
            counts[w] += 1
            first[w] = min(first.get(w, (True, 1 << 40, 0)), (k is not None, k or 0, at))
    want = {(w, counts[w], k if named else None, at) for w, (named, k, at) in first.items()}
    for most in (search.MOST_WORDS, 2):
        monkeypatch.setattr(search, "MOST_WORDS", most)
        found = search.vocabulary_of(prepare(spark).createDataFrame(rows, "passage long, lines array<array<string>>").repartition(3))
        assert {tuple(x) for x in found.collect()} == want


def test_margin_makes_its_hits_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(1, 1, 10, 3, 0.9), (1, 2, 10, 5, 0.8), (1, 3, 11, 3, 0.5), (2, 1, 10, 1, 0.4)]
    ddl = "query long, rank int, passage long, line_no int, score double"
    hits = prepare(spark).createDataFrame(rows, ddl).mapInArrow(seen, ddl)
    got = {(x.query, x.passage, round(x.lead, 3), x.locked) for x in search.margin(hits).collect()}
    assert got == {(1, 10, 0.4, True), (2, 10, 0.4, False)} and made.value == len(rows)


def test_search_once_shuffles_no_trigrams(spark, monkeypatch):
    r = random.Random(12)
    texts = [(k, None if k % 9 == 0 else "".join(r.choice("aBcé ") for _ in range(r.randint(0, 60)))) for k in range(90)]
    asked = [(q, "".join(r.choice("abCé ") for _ in range(r.randint(1, 4)))) for q in range(30)] + [(40, "ab"), (41, "zzz")]
    df, wanted = prepare(spark).createDataFrame(texts, "id long, text string").repartition(4), spark.createDataFrame(asked, "query long, literal string")
    want = {(q, k) for q, s in asked for k, t in texts if t is not None and s.lower() in t.lower()}
    for limits in ({}, {"FEW": 0}, {"HELD": 3}):
        for k, v in limits.items():
            monkeypatch.setattr(substrings, k, v)
        assert {tuple(x) for x in substrings.search_once(df, wanted, "id", "text", 16).collect()} == want


def test_asked_grams_are_found_as_by_plain_python():
    """Runs over lines, never over rows; null and empty rows and lines, words with blanks."""
    r = random.Random(20)
    for n in (1, 2, 4):
        for _ in range(60):
            pool = r.choice(["a b c".split(), ["a", "b", "a b", "c", ""], ["é", "öx", "b"]])
            word = lambda pool=pool: r.choice(pool)
            rows = [None if r.random() < 0.1 else [[word() for _ in range(r.randint(0, 6))] for _ in range(r.randint(0, 4))] for _ in range(8)]
            grams = frozenset(" ".join(word() for _ in range(n)) for _ in range(r.randint(0, 6)))
            want = []
            for k, lines in enumerate(rows):
                flat = [(w, i + 1) for i, ws in enumerate(lines or []) for w in ws]
                for at in range(len(flat) - n + 1):
                    if (g := " ".join(w for w, _ in flat[at : at + n])) in grams:
                        want.append((k, flat[at][1], at, g))
            given = pa.array([[], *rows, []], pa.list_(pa.list_(pa.string()))).slice(1, len(rows))
            row, line, pos, found = search.Asked(grams, n).places(given)
            assert list(zip(row.tolist(), line.tolist(), pos.tolist(), found, strict=True)) == want
