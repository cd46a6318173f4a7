"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers; the
network adds what they miss. It is trained in numpy, each time, on labelled windows: those
around base spans of a bounded, hash-ordered sample of the table (``SAMPLE`` windows at
most) and generated ones, which also hold written variants that the patterns don't
know: national phone numbers, cards with other separators, defanged addresses and e-mail
addresses with the sign spelled out. A window's tags are BIO over the four kinds.

At scan time a text is covered by windows of ``WIDTH`` characters that overlap by half.
No label occurs without a digit or an at sign (or a bracketed "at"), so windows without
them, and without neighbours that have one, are all O by constraint and cost nothing. Windows are not decoded
one by one: each character's emissions are averaged over its windows, weighted by the
distance to their edges, and one Viterbi pass with the CRF's transitions decodes each
stretch of touching windows as a whole, so no span breaks at a window's edge. What it finds
counts where it meets its kind's form and touches no base span.

Defined cases: null text counts as empty; a doc_id may be null or repeated, one row comes back
per input row; an empty table trains on generated windows and gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import discard, materialise, prepare
from .spans import Span, Taken, digest, joined

KINDS = ("email", "ip", "card", "phone")
WIDTH, STEP = 64, 32
#: Windows of the table that the network learns from, at most.
SAMPLE = 400
GENERATED = 1600
HIDDEN, EMBED, EPOCHS, BATCH = 16, 10, 8, 50
#: Characters of which emissions are held at once.
HELD = 1 << 17
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The base patterns, with possessive runs where nothing is to be given back.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]")
#: How written variants spell the marks of an address.
_AT = re.compile(r"@|[(\[{] ?at ?[)\]}]")
_ADDRESS = re.compile(r"[0-9]{1,3}(?:[\x20(\[{]{0,2}(?:\.|dot)[\x20)\]}]{0,2}[0-9]{1,3}){3}")
#: Tags: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """As a leftmost scan finds them: an at sign, the longest local part before it that no
    earlier match has taken, and the longest domain behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", at + 1)
    return out


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    if not _TRIGGER.search(text):
        return []
    found = _emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


_CLASSES = "@.+-()_%:/,;#*|$&!?\"'=[]<> \n"


def encode(text: str) -> np.ndarray:
    """Characters as classes: padding 0, letters, digits, marks each on its own, others."""
    return np.array([_CLASS.get(c) or (2 if c.islower() else 3 if c.isupper() else 5) for c in text], np.int64)


_CLASS = {c: 6 + i for i, c in enumerate(_CLASSES)} | dict.fromkeys("0123456789", 4)
N_CLASSES = 6 + len(_CLASSES)


def tags_of(spans: list[Span], start: int, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        for i in range(max(s, start), min(e, start + width)):
            out[i - start] = 1 + 2 * k + (i > s)
    return out


# ------------------------------------------------------------------ network


def _allowed() -> np.ndarray:
    """0 where a tag may follow a tag, else a large penalty: I only after its B or I."""
    out = np.zeros((TAGS, TAGS))
    for b in range(1, TAGS):
        if b % 2 == 0:
            for a in range(TAGS):
                if a not in (b, b - 1):
                    out[a, b] = -1e4
    return out


MASK = _allowed()
START = np.where([t and t % 2 == 0 for t in range(TAGS)], -2.0, 0.0)


def init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"emb": r.normal(0, 0.3, (N_CLASSES, EMBED)), "out": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        p["w" + d] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
        p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
    """x: time x batch x embed -> hidden states; what a backward pass needs if ``keep``."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    hs, kept = np.empty((steps, n, HIDDEN), x.dtype), []
    for t in range(steps):
        z = np.concatenate([x[t], h], axis=1)
        g = z @ w + b
        i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        u = np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            kept.append((z, i, f, o, u, before, tc))
    return hs, kept


def _lstm_back(dhs: np.ndarray, kept, w: np.ndarray):
    dw, db, dx = np.zeros_like(w), np.zeros(w.shape[1]), np.empty((len(kept), dhs.shape[1], EMBED))
    dh, dc = np.zeros(dhs.shape[1:]), np.zeros(dhs.shape[1:])
    for t in range(len(kept) - 1, -1, -1):
        z, i, f, o, u, before, tc = kept[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dw += z.T @ dg
        db += dg.sum(0)
        dz = dg @ w.T
        dx[t], dh, dc = dz[:, :EMBED], dz[:, EMBED:], dc * f
    return dw, db, dx


def emissions(p: dict[str, np.ndarray], x: np.ndarray, keep: bool = False):
    """x: batch x time of classes -> time x batch x tags."""
    e = p["emb"][x.T]
    hf, kf = _lstm(e, p["wf"], p["cf"], keep)
    hb, kb = _lstm(e[::-1], p["wb"], p["cb"], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ p["out"] + p["bias"], (h, kf, kb)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(em: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Mean negative log likelihood, and its gradients by emissions and transitions."""
    steps, n, k = em.shape
    full = trans + MASK
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0] + START
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + full[None], 1) + em[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(full[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    d_em = np.exp(alpha + beta - z[None, :, None])
    d_tr = np.zeros_like(trans)
    for t in range(1, steps):
        d_tr += np.exp(alpha[t - 1][:, :, None] + full[None] + (em[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
    rows, gold = np.arange(n), np.zeros(n)
    for t in range(steps):
        y = tags[:, t]
        gold += em[t][rows, y] + (START[y] if t == 0 else full[tags[:, t - 1], y])
        d_em[t][rows, y] -= 1
        if t:
            np.subtract.at(d_tr, (tags[:, t - 1], y), 1)
    return (z - gold).mean(), d_em / n, d_tr / n


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled batches; x, y: windows x time."""
    p = init(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = r.permutation(len(x))
        for at in range(0, len(x), BATCH):
            xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            em, (h, kf, kb) = emissions(p, xb, keep=True)
            _, d_em, d_tr = crf(em, yb, p["trans"])
            g = {"trans": d_tr, "bias": d_em.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", h, d_em)}
            dh = d_em @ p["out"].T
            g["wf"], g["cf"], df = _lstm_back(dh[:, :, :HIDDEN], kf, p["wf"])
            g["wb"], g["cb"], db = _lstm_back(dh[::-1, :, HIDDEN:], kb, p["wb"])
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], xb.T, df + db[::-1])
            step += 1
            for k in p:
                grad = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in p.items()}


def viterbi(em: np.ndarray, trans: np.ndarray) -> list[int]:
    """em: time x tags -> the best tag sequence under the constraints."""
    full, score, back = trans + MASK, em[0] + np.where(START < 0, -1e4, 0), []
    for t in range(1, len(em)):
        s = score[:, None] + full
        back.append(s.argmax(0))
        score = s.max(0) + em[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


# ------------------------------------------------------------------ training windows


def generated(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows of invented words around values of each kind, and around look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwzé") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = d(15)
        last = next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", "  ", ".", "/", " - "])
        return sep.join((body + last)[i : i + 4] for i in range(0, 16, 4))

    at = lambda: r.choice(["@", "@", "@", " @ ", "(at)", "[at]", " (at) ", " [at] "])
    dot = lambda: r.choice([".", ".", ".", "[.]", "(.)", " . "])

    def phone() -> str:
        forms = [f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(11)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(3)}/{d(6)}"]
        return r.choice(forms)

    def ip() -> str:
        sep = dot()
        return sep.join(str(r.randint(0, 255)) for _ in range(4))

    make = {
        "email": lambda: f"{word()}{r.choice(['', '.', '_', '+'])}{d(r.randint(0, 3))}x{at()}{word()}.{r.choice(['com', 'org', 'example.com', 'de'])}",
        "ip": ip,
        "card": card,
        "phone": phone,
    }
    decoy = [lambda: d(r.randint(1, 6)), lambda: f"{d(1)}.{d(1)}.", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"v{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"@{word()}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(3)},{d(3)}.{d(2)}", lambda: f"({d(4)})", lambda: d(r.randint(7, 20))]
    xs, ys = [], []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH:
            pick = r.random()
            if pick < 0.3:
                kind = r.choice(KINDS)
                value = make[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += r.choice(decoy)() if pick < 0.45 else word()
            text += r.choice([" ", " ", " ", ", ", ". ", "\n", "!! "])
        xs.append(encode(text[:WIDTH]))
        ys.append(tags_of(spans, 0, WIDTH))
    return np.array(xs), np.array(ys)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows around base spans, with a hash that orders them for sampling."""
    rows: list[tuple[bytes, bytes]] = []

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.binary())], ["x", "y"])
        rows.clear()
        return out

    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = sorted(base_spans(text), key=lambda x: x[1:])
            for i, (_, s, _) in enumerate(spans):
                start = max(0, s - s % 29)
                x = encode(text[start : start + WIDTH])
                # spans are in order: those that reach into the window are near this one
                near = [z for z in spans[max(0, i - WIDTH) : i + WIDTH] if z[2] > start and z[1] < start + WIDTH]
                rows.append(tuple(a.astype(np.uint8).tobytes() for a in (np.pad(x, (0, WIDTH - len(x))), tags_of(near, start, WIDTH))))
                if len(rows) >= 4096:
                    yield emit()
    if rows:
        yield emit()


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    prepare(docs.sparkSession)
    # each window once, however many copies of it there are: one footer is one window
    windows = docs.select("text").filter(F.col("text").rlike("[0-9@]")).mapInArrow(_windows, "x binary, y binary")
    found = materialise(windows.distinct(), "pii-windows")
    # a share by hash first: the tasks together send about twice the sample, not each its own
    share = 2 * SAMPLE / max(found.count(), 1)
    thin = found.filter(F.pmod(F.xxhash64("y", "x"), F.lit(1_000_000)) < max(1, int(min(share, 1.0) * 1_000_000)))
    rows = thin.orderBy(F.xxhash64("x", "y"), "x").limit(SAMPLE).collect()
    discard(found)
    x, y = generated(GENERATED)
    if rows:
        read = lambda c: np.array([np.frombuffer(r[c], np.uint8) for r in rows], np.int64)
        x, y = np.concatenate([x, read("x")]), np.concatenate([y, read("y")])
    return train(x, y)


# ------------------------------------------------------------------ scan


def _stretches(text: str) -> list[tuple[int, int]]:
    """Touching windows that hold a digit or an at sign, as (first, last) window start."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        last = m.start() // STEP * STEP
        first = max(0, last - STEP)
        if out and first <= out[-1][1] + STEP:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


_WEIGHT = 1.0 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]).astype(np.float32)


def _formed(kind: str, value: str) -> bool:
    n = len(_digits(value))
    if kind == "email":
        return bool(_AT.search(value[1:-1])) and "." in value
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return bool(_ADDRESS.fullmatch(value)) and all(int(x) <= 255 for x in parts)
    return (12 <= n <= 19 and luhn(_digits(value))) if kind == "card" else 7 <= n <= 15


def _decode(text: str, sums: np.ndarray, start: int, trans: np.ndarray) -> list[Span]:
    """Spans of a stretch: Viterbi over its emissions, then each kind's form."""
    path, out, t = viterbi(sums, trans), [], 0
    while t < len(path):
        if path[t] == 0:
            t += 1
            continue
        kind, e = KINDS[(path[t] - 1) // 2], t + 1
        while e < len(path) and path[e] == (path[t] - 1) // 2 * 2 + 2:
            e += 1
        if _formed(kind, text[start + t : start + e]):
            out.append((kind, start + t, start + e))
        t = e
    return out


def added_spans(texts: list[str], base: list[list[Span]], model: dict[str, np.ndarray]) -> list[list[Span]]:
    """What the network adds to each text; windows of many texts go through together, as
    many stretches at a time as ``HELD`` characters allow; longer stretches go in parts."""
    out: list[list[Span]] = [[] for _ in texts]
    jobs = [(i, a, b) for i, text in enumerate(texts) for a, b in _parts(_stretches(text))]
    at = 0
    while at < len(jobs):
        end, held = at, 0
        while end < len(jobs) and (end == at or held + jobs[end][2] - jobs[end][1] + WIDTH <= HELD):
            held += jobs[end][2] - jobs[end][1] + WIDTH
            end += 1
        for (i, a, _), em in zip(jobs[at:end], _averaged(texts, jobs[at:end], model), strict=True):
            out[i] += _decode(texts[i], em, a, model["trans"])
        at = end
    for found, known in zip(out, base, strict=True):
        taken, kept = Taken(known), []
        for span in sorted(found, key=lambda x: x[1:]):
            if not taken.overlaps(span) and (not kept or kept[-1][2] <= span[1]):
                kept.append(span)
        found[:] = kept
    return out


def _parts(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of bounded length. Neighbouring parts share two windows, so that a value at
    the border is whole in one of them."""
    out = []
    for a, b in stretches:
        while b - a + WIDTH > HELD:
            cut = a + (HELD - WIDTH) // STEP * STEP
            out.append((a, cut))
            a = cut - 2 * STEP
        out.append((a, b))
    return out


def _averaged(texts: list[str], jobs: list[tuple[int, int, int]], model: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Each job's emissions by character, averaged over the windows that hold it."""
    starts = [(j, s) for j, (_, a, b) in enumerate(jobs) for s in range(a, b + 1, STEP)]
    sums = [np.zeros((b - a + WIDTH, TAGS), np.float32) for _, a, b in jobs]
    weights = [np.zeros(b - a + WIDTH, np.float32) for _, a, b in jobs]
    for at in range(0, len(starts), 512):
        part = starts[at : at + 512]
        x = np.zeros((len(part), WIDTH), np.int64)
        for k, (j, s) in enumerate(part):
            c = encode(texts[jobs[j][0]][s : s + WIDTH])
            x[k, : len(c)] = c
        em, _ = emissions(model, x)
        for k, (j, s) in enumerate(part):
            o = s - jobs[j][1]
            sums[j][o : o + WIDTH] += em[:, k] * _WEIGHT[:, None]
            weights[j][o : o + WIDTH] += _WEIGHT
    for (i, a, _), s, w in zip(jobs, sums, weights, strict=True):
        n = min(len(s), len(texts[i]) - a)
        yield s[:n] / w[:n, None]


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                base = [base_spans(x) for x in texts]
                more = added_spans(texts, base, model)
                rows = [(*(sum(x[0] == k for x in b) for k in KINDS), digest(b, KINDS), joined(b + m, KINDS)) for b, m in zip(base, more, strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def scan_pii(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, digest and spans; no shuffle of texts."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan(fit(docs)), _OUT)
