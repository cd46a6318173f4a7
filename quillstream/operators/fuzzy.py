"""Nearest known words by an equi-join on signatures, instead of tokens times vocabulary.

Words of lengths m and n score 200 * LCS / (m + n), so a score of ``cutoff`` takes a common
subsequence of at least ``common(m, n)`` letters, and as many letters in common, each counted by
its occurrence. Letters are put in one order for all words, rare ones first. If two words
share c letters, the first m - c + k and the first n - c + k of them share k: so words meet
in all choices of k letters from these beginnings. The choice is made for each pair of lengths,
as c is known for these; the two lengths and the chosen letters are the signature. k is larger
where few letters may differ, so that a signature is rare and a word has few of them.

No pair over the cutoff is lost, whatever the letters; what meets is scored by the LCS itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_udf
from ..sources.session import prepare

#: How many letters are chosen, by how many may differ on the side that may differ more.
_CHOSEN = ((3, 6), (5, 4), (8, 3), (12, 2))


def common(m: int, n: int, cutoff: float) -> int:
    """Letters that words of these lengths have in common at least, if they score the cutoff."""
    need = int(cutoff * (m + n) / 200)
    return need if 200.0 * need >= cutoff * (m + n) else need + 1


@cache
def _choice(m: int, n: int, cutoff: float) -> tuple[int, int] | None:
    """For a word of length m and partners of length n: how many of its first letters are
    chosen from, and how many are chosen; None if the lengths can't score the cutoff."""
    c = common(m, n, cutoff)
    if c > min(m, n) or c == 0:
        return None
    differ = max(m, n) - c
    k = min(c, next((k for most, k in _CHOSEN if differ <= most), 1))
    return m - c + k, k


def ordered_letters(word: str, rank: dict[str, int]) -> list[str]:
    """The letters of a word, each with its occurrence, in the order that all words share."""
    seen: Counter = Counter()
    out = []
    for c in word:
        seen[c] += 1
        out.append((-seen[c], rank.get(c, -1), c))
    return [f"{c}{-n}" for n, _, c in sorted(out)]


def signatures(word: str, partners: list[int], rank: dict[str, int], cutoff: float, swapped: bool) -> Iterator[str]:
    """Of a word, for partners of these lengths. ``swapped``: the word is the second of a pair."""
    letters = ordered_letters(word, rank)
    for n in partners:
        if (choice := _choice(len(word), n, cutoff)) is not None:
            lengths = f"{n}:{len(word)}:" if swapped else f"{len(word)}:{n}:"
            for chosen in combinations(letters[: choice[0]], choice[1]):
                yield lengths + "".join(chosen)


def _signed(column: str, partners: list[int], rank: dict[str, int], cutoff: float, swapped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                words, found = [], []
                for w in batch.column(0)[at : at + 1000].to_pylist():
                    own = list(signatures(w, partners, rank, cutoff, swapped))
                    words += [w] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(found, pa.string())], [column, "signature"])

    return run


def _lengths(words: DataFrame, column: str) -> list[int]:
    """The different lengths of words: a number or two of digits, however many words."""
    return sorted(r[0] for r in words.select(F.length(column)).distinct().collect())


def candidates(wanted: DataFrame, vocabulary: DataFrame, cutoff: float) -> DataFrame:
    """token, word: pairs that share a signature; all pairs that score the cutoff are among them.
    ``wanted``: token; ``vocabulary``: word."""
    prepare(wanted.sparkSession)
    tokens, words = wanted.select("token").filter("token <> ''").distinct(), vocabulary.select("word").filter("word <> ''").distinct()
    asked, known = _lengths(tokens, "token"), _lengths(words, "word")
    counts = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()  # a row a letter
    rank = {r["c"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["c"])))}
    left = tokens.mapInArrow(_signed("token", known, rank, cutoff, False), "token string, signature string")
    right = words.mapInArrow(_signed("word", asked, rank, cutoff, True), "word string, signature string")
    return left.join(right, "signature").select("token", "word").distinct()


def nearest_words(wanted: DataFrame, vocabulary: DataFrame, cutoff: float, order: tuple[str, ...] = ()) -> DataFrame:
    """token, word, similarity: for each token the most similar word of at least the cutoff; on ties
    the one that comes first by the vocabulary's columns ``order``, then by itself."""
    met = candidates(wanted, vocabulary, cutoff).withColumn("similarity", ratio_udf("token", "word")).filter(F.col("similarity") >= cutoff)
    ranked = met.join(vocabulary.select("word", *order), "word") if order else met
    best = F.min_by(F.struct("word", "similarity"), F.struct(-F.col("similarity"), *order, "word"))
    return ranked.groupBy("token").agg(best.alias("b")).select("token", "b.word", "b.similarity")
