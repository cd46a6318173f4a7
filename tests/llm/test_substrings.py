"""Suffix arrays by groups and the removal of repeated strings, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import substring_dedup, suffix_groups
from quillstream.sources.session import prepare


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=6))
def test_suffix_arrays(texts):
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.append(0, ends)
    symbols = np.array([x for t in texts for x in (*t, 0)])
    want = [b + i for b, t in zip(bounds.tolist(), texts, strict=False) for i in sorted(range(len(t) + 1), key=lambda i, t=t: [*t, 0][i:])]
    assert suffix_groups.suffix_arrays(symbols, bounds).tolist() == want
    # a group is the suffixes of one longest Lyndon prefix, and groups are in the order of these
    _, group, length = suffix_groups.lyndon_groups(symbols, bounds)
    for b, t in zip(bounds.tolist(), texts, strict=False):
        t = [*t, 0]
        lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
        words = [max((t[i : i + n] for n in range(1, len(t) - i + 1) if lyndon(t[i : i + n])), key=len) for i in range(len(t))]
        assert [len(w) for w in words] == length[b : b + len(t)].tolist()
        assert sorted(range(len(t)), key=lambda i: words[i]) == sorted(range(len(t)), key=lambda i, b=b: (group[b + i], words[i]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=6), st.sampled_from([16, 32, 50]), st.integers(1, 300))
def test_each_window_is_in_one_piece(texts, gram, hashed):
    before, substring_dedup.HASHED = substring_dedup.HASHED, hashed
    try:
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        start, count, hashes, text = substring_dedup.pieces(np.frombuffer(data, np.uint8), ends, gram)
    finally:
        substring_dedup.HASHED = before
    at = np.append(0, ends)
    windows = [(p, t) for t in range(len(texts)) for p in range(at[t], at[t + 1] - 49)]
    assert sorted((s + k, t) for s, n, t in zip(start, count, text, strict=True) for k in range(n)) == windows
    # equal windows have one hash, wherever they stand
    of = {}
    for s, n, h in zip(start.tolist(), count.tolist(), hashes.tolist(), strict=True):
        for k in range(n):
            assert of.setdefault(data[s + k : s + k + 50], h) == h
    assert count.max(initial=0) <= substring_dedup.MOST


def removed_by_hand(rows):
    least = {}
    for i, t in rows:
        for p in range(len(t) - 49 if i is not None else 0):
            least[t[p : p + 50]] = min(i, least.get(t[p : p + 50], i))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49 if i is not None else 0):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        edges = [p for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1])]
        spans = [(p, next((q for q in range(p, len(t)) if not gone[q]), len(t))) for p in edges]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(50)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randint(2, 9)))
    say = lambda n: "".join(word() for _ in range(n))
    shared = [say(n) for n in (9, 12, 30, 60)] + ["x" * 49, "x" * 50, "x" * 300, "ab" * 60, "footer " * 8]
    texts = [None, "", "short", *shared, "z" * 5000]
    texts += ["".join(r.choice([*shared, say(20), say(3)]) for _ in range(r.randint(1, 6))) for _ in range(60)]
    # the edges of one passage in many documents: many contents under few hashes
    texts += [say(30) + shared[2] + say(30) for _ in range(250)]
    texts += [texts[20]] * 3 + [texts[25] + "!", say(9) + texts[25]]
    out = [(r.randint(0, 10**12) if k % 3 else k, t) for k, t in enumerate(texts)]
    return [*out, (None, texts[20]), (None, texts[30]), (out[30][0], texts[40]), out[31]]


@pytest.mark.parametrize("limits", [{}, {"LIMIT": 300, "BATCH": 3000, "SORTED": 500, "COMPARED": 4000, "FEW": 0}])
def test_remove_repeats(spark, monkeypatch, rows, limits):
    for k, v in limits.items():
        monkeypatch.setattr(substring_dedup, k, v)
    df = prepare(spark).createDataFrame([(*x, 1, "h", 2) for x in rows], "doc_id long, text string, batch int, hash string, start int").repartition(5)
    got = [(x.doc_id, x.n_bytes, x.n_removed, [tuple(s) for s in x.spans], x.kept_sha256, bytes(x.kept)) for x in substring_dedup.remove_repeats(df, True).collect()]
    want = removed_by_hand([(i, (t or "").encode()) for i, t in rows])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in got) > 10_000
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_pieces_cut_again_are_names_and_go(spark, monkeypatch, rows):
    """Their number grows faster than the input: no bytes are stored with them, and no table of them stays."""
    monkeypatch.setattr(substring_dedup, "LIMIT", 300)
    seen, gone, write, drop = {}, [], substring_dedup.materialise, substring_dedup.discard

    def kept(df, tag):
        out = write(df, tag)
        seen[out.scratch] = (tag, out.columns)
        return out

    monkeypatch.setattr(substring_dedup, "materialise", kept)
    monkeypatch.setattr(substring_dedup, "discard", lambda *tables: (gone.extend(t.scratch for t in tables), drop(*tables)))
    substring_dedup.remove_repeats(prepare(spark).createDataFrame(rows, "doc_id long, text string")).count()
    children = [columns for tag, columns in seen.values() if tag == "substring-children"]
    assert len(children) == 2 and not any("data" in columns for columns in children)
    assert {tag for path, (tag, _) in seen.items() if path not in gone} == {"substring-copies", "substring-batches", "substring-found"}
