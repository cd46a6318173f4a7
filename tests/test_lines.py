"""Sums and runs of lines, made inside a passage's row, against plain Python."""

import random
from collections import Counter

from quillstream.operators import corpus
from quillstream.sources.session import prepare


def passages(repeated):
    r = random.Random(17)
    say = lambda: [r.choice("ab cd é öx longer".split()) for _ in range(r.randint(0, 7))]
    rows = [(k, [say() for _ in range(r.randint(0, 5))]) for k in range(40)] + [(None, [["ab", "cd", "ab", "cd"]])]
    return rows + ([(3, [["ab", "cd", "ab"], ["ab"]]), (3, [["ab", "cd", "ab", "cd"]]), (None, [["ab", "cd", "ab"]])] if repeated else [])


def test_line_sums_explode_no_words(spark):
    rows = passages(False)
    found = corpus.line_sums(prepare(spark).createDataFrame(rows, "passage long, lines array<array<string>>"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    want = []
    for k, lines in rows:
        for i, ws in enumerate(lines):
            if ws:
                want.append((k, i + 1, len(ws), sum(map(len, lines[:i])), min(ws, key=lambda w: w.encode()), max(map(len, ws))))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_line_gram_counts_shuffle_runs_alone(spark):
    for repeated in (False, True):
        rows = passages(repeated)
        found = corpus.line_gram_counts(prepare(spark).createDataFrame(rows, "passage long, lines array<array<string>>"), 3)
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
        grams = {(k, i, " ".join(ws[j : j + 3])) for k, lines in rows for i, ws in enumerate(lines) for j in range(len(ws) - 2)}
        assert dict(map(tuple, found.collect())) == Counter(g for _, _, g in grams)
