"""The nearest known word by signatures, against comparing everything."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.functions.similarity import ratio, ratios
from quillstream.operators import fuzzy, search


def garbled(r, w):
    ws = list(w)
    for _ in range(r.choice([1, 1, 2, 3, 5])):
        k = r.randrange(len(ws) + 1)
        how = r.random()
        if how < 0.4 and ws:
            del ws[min(k, len(ws) - 1)]
        elif how < 0.7:
            ws.insert(k, r.choice("abcdefghiklmnoprstuvé"))
        elif ws:
            ws[min(k, len(ws) - 1)] = r.choice("abcdefghiklmnoprstuvé")
    return "".join(ws)


@pytest.mark.parametrize("cutoff", [78.0, 60.0, 100.0])
def test_no_pair_over_the_cutoff_is_lost(cutoff):
    r = random.Random(3)
    words = ["".join(r.choice("aabbcd") for _ in range(r.randint(1, 12))) for _ in range(120)]
    words += [garbled(r, w) or "a" for w in words] + ["a", "ab", "ba", "x" * 40, "x" * 39 + "y"]
    words = sorted({w for w in words if w})
    lengths, rank = sorted({len(w) for w in words}), {c: i for i, c in enumerate("dcbaxy")}
    own = {w: (set(fuzzy.signatures(w, lengths, rank, cutoff, False)), set(fuzzy.signatures(w, lengths, rank, cutoff, True))) for w in words}
    for a, b in itertools.product(words, words):
        if ratio(a, b) >= cutoff:
            assert own[a][0] & own[b][1], (a, b)


def test_nearest_words(spark):
    r = random.Random(4)
    vocabulary = sorted({"".join(r.choice(s) for s in ("bcdfgklmnprst", "aeiou") * r.randint(1, 5)) + r.choice(["", "n", "s", "ung"]) for _ in range(4000)})
    wanted = sorted({garbled(r, r.choice(vocabulary)) for _ in range(250)} | {"", "qqqq", "é", "z" * 60})
    known = spark.createDataFrame([(w, i % 7, i) for i, w in enumerate(vocabulary)], "word string, first_passage long, first_pos long").repartition(3)
    asked = spark.createDataFrame([(w,) for w in wanted] * 2, "token string")
    want, pairs = {}, 0
    for t in wanted:
        scored = [(-ratio(t, w), i % 7, i, w) for i, w in enumerate(vocabulary) if t]
        pairs += sum(-s >= 78 for s, *_ in scored)
        if scored and -min(scored)[0] >= 78:
            want[t] = (min(scored)[3], -min(scored)[0])
    got = {x.token: (x.word, x.similarity) for x in fuzzy.nearest_words(asked, known, 78.0, ("first_passage", "first_pos")).collect()}
    assert {k: (w, round(s, 9)) for k, (w, s) in got.items()} == {k: (w, round(s, 9)) for k, (w, s) in want.items()}
    met = fuzzy.candidates(asked, known, 78.0).count()
    assert pairs <= met <= 10 * pairs, (met, pairs, len(wanted) * len(vocabulary))
    # words that are known are not looked up
    fixed = search.corrections(known, asked.union(known.limit(50).select("word")))
    assert {x.token for x in fixed.collect()} == {t for t in want if t not in vocabulary}
    assert fuzzy.nearest_words(asked.limit(0), known, 78.0).count() == 0 == fuzzy.nearest_words(asked, known.limit(0), 78.0).count()


def test_ratios_side_by_side_equal_single_ones():
    r = random.Random(8)
    for alphabet, longest in (("ab", 9), ("abcdef é中\U0001f600", 150), ("".join(map(chr, range(0x4E00, 0x6E00))), 90)):
        a = ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(600)]
        b = [x[::-1] if r.random() < 0.3 else "".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for x in a]
        assert list(ratios(a, b)) == [ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert list(ratios([], [])) == [] and list(ratios(["", ""], ["", "a"])) == [100.0, 0.0]


def test_tokens_are_split_without_squeezing(spark):
    texts = ["", None, "  Ab\t\tcd-ef\x0b\x0cgh \r\n", "x y z w", "É ß ÿ × ÷ 1 a1b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    squeezed = F.filter(F.split(F.coalesce(text.letters("t"), F.lit("")), " "), lambda x: x != "")
    assert all(a == b for a, b in df.select(squeezed, text.tokens("t")).collect())
