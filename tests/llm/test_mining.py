"""Hard negatives and the filter audit against brute force, on small tables with nulls, ties,
repeated rows, hot labels and clashing columns."""

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quillstream.llm import filter_audit, hard_negatives
from quillstream.sources.session import prepare


def negatives_by_hand(rows):
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
            use.append((i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for i, label, v in (r for r in use if r[0] % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in use if len(w) == len(v) and j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out.update((i, positive, rank, j, -p, -s) for rank, (s, j, _) in enumerate(fit[:3], 1))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, blocks string, anchor int, score double"


@pytest.mark.parametrize("limits", [(4096, 512, 32 << 20), (7, 3, 2000)])
def test_hard_negatives(spark, monkeypatch, limits):
    r = random.Random(2)
    for name, value in zip(("BLOCK", "SLICE", "GROUP_BYTES"), limits, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    vector = lambda n=4: [r.choice([-1, -0.5, 0, 0.25, 0.3, 0.9, 1.0]) for _ in range(n)]
    rows = [(i * 5, vector(), r.choice([0, 0, 0, 1, 2, 9])) for i in range(150)]  # many ties, a hot label
    rows += [(None, vector(), 1), (50, None, 1), (55, vector(), None), (100, [1.0, None, 0, 0], 1), (60, [1.0, float("nan"), 0, 0], 1), (65, [float("-inf"), 0, 0, 0], 1), (200, [], 1), (205, [], 2), (250, vector(7), 3), (252, vector(7), 3), (300, vector(), 4), rows[10], rows[10]]
    # floats as the table holds them
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]
    df = prepare(spark).createDataFrame([(*x, "x", 1, 2.0) for x in rows], SCHEMA).repartition(3)
    got = Counter(tuple(x) for x in hard_negatives.hard_negatives(df).collect())
    want = negatives_by_hand(rows)
    assert got == want and len(want) > 50
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_scores_are_exact_past_float64():
    a, b = np.array([[float(1 << 30), 3.0]]), np.array([[float(1 << 30), 5.0], [1.0, 1.0]])
    assert hard_negatives.scores(a, b).tolist() == [[(1 << 60) + 15, (1 << 30) + 3]]
    assert hard_negatives.scores(np.empty((2, 0)), np.empty((3, 0))).shape == (2, 3)
    with pytest.raises(OverflowError):
        hard_negatives.scores(a * float(1 << 20), b)


def audit_by_hand(docs, labels):
    import re

    texts, out = [(i, t or "", lang or "") for i, t, lang in docs], Counter()
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        f["E"] = i is not None and any(j is not None and j < i and t == u for j, u, _ in texts)
        fails.append((i, part, {k for k, v in f.items() if v}))
    for part in {p for _, p, _ in fails}:
        rows = [(i, f) for i, p, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [i for i, f in left if k in f]
                left = [x for x in left if k not in x[1]]
                shapley[k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in f for _, f in rows) - len(gone), sum(f == {k} for _, f in rows), sum(i in good for i in gone), sum(i in toxic for i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_filter_audit(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    texts = [None, "", " \n", "a", "A B", "x#", "É" * 9 + "A", "same text " * 60, " ".join(word() for _ in range(120)), " ".join(word() for _ in range(120)) + " & CO", "long " * 30_000]
    texts += [" ".join(r.choice(["up", "UP", word(), word(), word()]) for _ in range(r.randint(80, 140))) for _ in range(30)]
    docs = [(i, r.choice(texts), r.choice(["en", "en", "de", None, ""])) for i in range(300)] + [(None, t, "en") for t in texts[:8]] * 2
    docs += [docs[7], (docs[7][0], docs[7][1], "fr"), (-5, texts[8], "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = prepare(spark).createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, lang string, n int, part string, fails int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): list(x)[3:] for x in filter_audit.audit_filters(df, marks).collect()}
    assert got == audit_by_hand(docs, labels)
    assert filter_audit.audit_filters(df.limit(0), marks).count() == 0
    assert all(x.good_lost == 0 for x in filter_audit.audit_filters(df, marks.limit(0)).collect())


def test_incidence_matrices():
    m = filter_audit.incidence()
    assert all(x.shape == (32, 600) for x in m.values())
    # a set of failures is removed at one step of each order, the empty one never
    per_order = m["removed"].reshape(32, 120, 5).sum(axis=2)
    assert not per_order[0].any() and (per_order[1:] == 1).all()
