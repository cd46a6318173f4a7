"""Language-model scores by online logistic context mixing.

A text is its words, lower-cased in A-Z, and one end; a token is spelled as its bytes and a
stop. The model predicts each bit of the spelling:

* predictors: for contexts of 1 to 4 preceding bytes and for the whole prefix of the word, a
  hashed table holds how often each bit was 0 and 1 over all training tokens;
* gated mixing: the predictors' log odds are combined by weights that the bit's place in the
  byte and the trust in the longest contexts select, learned online over all training
  words, each left out of its own counts (a word seen once is met as a new one);
* adaptive refinement: a curve per gate corrects the mixed odds by what it met so far;
* a token's probability mixes that spelling with the token's frequency in the corpus and
  in one of ``CLASSES`` classes of documents (the most frequent values of lang, and the rest);
* a text's class is not told: all classes predict side by side, and each token shifts the
  trust between them by Bayes' rule.

Texts are then read in order (``Reader``): the ``CODED`` most frequent tokens and an escape to all others
have a Huffman code, and each bit of it is predicted by the token's frequency, that in the class that
the text so far speaks for, and what followed the word before and the two words before, in hashed
tables. Their log odds are mixed by weights that the counts of these contexts select; the weights are
learned online in one pass over the training texts, each predicted before it is counted, and go on
moving within each text while it is scored (every text from the same start, so that its score doesn't
depend on others).

Only the spelling behind an escape ends with the word, so that its cost in a class depends on the token
alone and each distinct token is spelled once, however often it occurs. Counts, tables and weights cover all training documents. Tables, weights and the
``FREQUENT`` most frequent tokens, whose sizes are fixed, are broadcast; every other
token meets its documents in a join by token, which no frequent token takes part in.

Base score: the sum of log10((c + 1) / (N + V + 1)), c the token's count, N all and V the
distinct training tokens. Documents whose crc32 of doc_id mod 7 is 2 are held out.

Defined cases: null text counts as empty and is one end; a null doc_id counts as training; repeated
rows count each and give a row each; without training documents all tokens are unknown
and the model spells by even odds; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import PER_TASK, discard, materialise, prepare
from .simhash import lower_words

#: Slots of the predictors' tables, as powers of two: 1 to 4 bytes, and the prefix.
SLOTS = (16, 19, 20, 20, 21)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOTS])])
ORDERS = len(SLOTS)
#: Tokens that are scored by broadcast, at most.
FREQUENT = 300_000
#: Classes of documents, the last one for all values of lang that aren't frequent.
CLASSES = 5
#: The end of a text; no word holds a line break. The stop ends a word's spelling.
END, _STOP = "\n", b" "
GATES = 8 * 6
#: Words of a step of learning, bytes that are spelled at once, and bytes of a piece: longer
#: tokens are spelled in pieces, whose contexts start anew.
WORDS, BYTES, PIECE = 2048, 1 << 15, 4096
#: Distinct tokens that a task counts before it hands them on.
HELD = 800_000
#: Ranges of the table that are summed each by itself.
BLOCKS = 64
#: Tokens with a code; slots of what follows a word, and two words, as a power of two; gates of that.
CODED, PAIRS, READS = (1 << 12) - 1, 20, 16
#: Words after which a text's weights move, by how much, and how many bits it takes.
STEP, RATE, CALM = 32, 1.0, 100
#: Texts that are read side by side.
TEXTS = 256
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_N1, _N2, _N3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_B = np.uint64(0x100000001B3)
_BI = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return [*lower_words(text), END]


# ------------------------------------------------------------------ spelling


def spelling(token: str) -> list[bytes]:
    """A token's bytes and its stop, in pieces of ``PIECE`` bytes at most."""
    raw = token.encode("utf-8", "surrogatepass")
    if len(raw) < PIECE:
        return [raw + _STOP]
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)] + [_STOP]


def spell(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots: orders x bits, bits, piece of each bit) for all bits of some pieces."""
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in raw])
    word = np.repeat(np.arange(len(raw)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[word]
    at = np.arange(len(data))
    place = at - first
    with np.errstate(over="ignore"):
        contexts, h = [], np.full(len(data), 7, np.uint64)
        for k in range(1, 5):
            before = np.where(place >= k, data[np.maximum(at - k, 0)] + np.uint64(1), np.uint64(0))
            h = (h + before) * _M1
            h ^= h >> np.uint64(29)
            contexts.append(h)
        up = np.cumprod(np.full(len(data), _B, np.uint64))
        down = np.cumprod(np.full(len(data), _BI, np.uint64))
        run = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * up)])
        contexts.append((run[at] - run[first]) * down[first] * _M2 + np.uint64(11))
        byte = data.astype(np.uint32)[:, None]
        j = np.arange(8, dtype=np.uint32)[None, :]
        node = ((np.uint32(1) << j) | (byte >> (np.uint32(8) - j))) * _N1
        bits = ((byte >> (np.uint32(7) - j)) & np.uint32(1)).astype(np.int8).ravel()
        slots = np.empty((ORDERS, len(data) * 8), np.int32)
        for k, (c, b) in enumerate(zip(contexts, SLOTS, strict=True)):
            x = ((c >> np.uint64(32)) ^ c).astype(np.uint32)[:, None] + node
            x ^= x >> np.uint32(15)
            x *= _N2
            x ^= x >> np.uint32(13)
            x *= _N3
            x >>= np.uint32(32 - b)
            np.add(x.ravel(), np.uint32(OFFSETS[k]), out=slots[k].view(np.uint32))
    return slots, bits, np.repeat(word, 8)


def count_bits(raw: list[bytes], counts: np.ndarray, table: np.ndarray) -> None:
    """Add some pieces, so often, to table (slots x 2)."""
    slots, bits, word = spell(raw)
    n, flat = counts[word].astype(np.float32), table.reshape(-1)
    for k in range(ORDERS):
        np.add.at(flat, slots[k] * np.int64(2) + bits, n)


def _cost(z: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """-log2 of the bits, whose log odds of a 1 are z."""
    wrong = np.where(bits == 1, -z, z)
    return (np.maximum(wrong, 0) + np.log1p(np.exp(-np.abs(wrong)))) * np.float32(1 / math.log(2))


class Odds:
    """What scoring reads of the table: each slot's log odds, and how far the two longest
    contexts are to be trusted."""

    def __init__(self, table: np.ndarray):
        n0, n1 = table[:, 0], table[:, 1]
        self.odds = np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))
        self.trust = _trust((n0 + n1)[OFFSETS[-2] :])
        self.met = n0 + n1 > 8

    def inputs(self, raw: list[bytes]):
        slots, bits, word = spell(raw)
        x = np.empty((ORDERS + 1, len(bits)), np.float32)
        np.take(self.odds, slots, out=x[:ORDERS], mode="clip")
        x[ORDERS] = 0.3
        gate = np.tile(_PLACES, len(bits) // 8) + self.trust.take(slots[-1] - OFFSETS[-2]) * np.int8(2) + self.met.take(slots[-2])
        return x, gate, bits, word


_PLACES = np.arange(8, dtype=np.int8) * 6


def _trust(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1) / 2, 2.99).astype(np.int8)


class Mixer:
    """Weights by gate, a refining curve by gate, and the share of a token's frequency."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, ORDERS + 1), 0.3, np.float32)
        self.curve = np.tile(np.linspace(-12, 12, 33, dtype=np.float32), (GATES, 1))
        self.shares = np.array([0.5, 0.2, 0.3])  # class frequency, frequency, spelling

    def inputs(self, raw: list[bytes], table: np.ndarray, out: float = 0.0):
        """(log odds: orders + 1 x bits, gates, bits, piece of each bit). ``out``: how often
        each piece is to be taken out of the counts first."""
        slots, bits, word = spell(raw)
        flat, at = table.reshape(-1), slots * np.int32(2)
        n0 = flat.take(at)
        at += np.int32(1)
        n1 = flat.take(at)
        if out:
            ones = bits.astype(np.float32) * np.float32(out)
            n1 -= ones
            n0 -= np.float32(out) - ones
            np.maximum(n0, 0, out=n0)
            np.maximum(n1, 0, out=n1)
        gate = np.tile(_PLACES, len(bits) // 8) + _trust(n0[-1] + n1[-1]) * np.int8(2) + (n0[-2] + n1[-2] > 8)
        x = np.empty((ORDERS + 1, len(bits)), np.float32)
        n0 += np.float32(0.05)
        n1 += np.float32(0.05)
        n1 /= n0
        np.log(n1, out=x[:ORDERS])
        x[ORDERS] = 0.3
        return x, gate, bits, word

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1], np.float32)
        for row, w in zip(x, self.weights.T, strict=True):
            z += row * w.take(gate)
        return np.clip(z, -11.9, 11.9)

    def refined(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = (odds + np.float32(12)) / np.float32(0.75)
        i = at.astype(np.int32)
        f = at - i
        cell, flat = gate * np.int32(33) + i, self.curve.reshape(-1)
        low = flat.take(cell)
        return np.float32(0.5) * (odds + low + (flat.take(cell + 1) - low) * f.astype(np.float32))

    def log2(self, raw: list[bytes], odds: Odds) -> np.ndarray:
        """log2 of each piece's spelling."""
        x, gate, bits, word = odds.inputs(raw)
        return -np.bincount(word, _cost(self.refined(self.mixed(x, gate), gate), bits), len(raw))

    def learn(self, raw: list[bytes], counts: np.ndarray, table: np.ndarray, rate: float) -> np.ndarray:
        """One online step over some training pieces, each left out of its own counts;
        log2 of their spellings as they were before the step."""
        x, gate, bits, word = self.inputs(raw, table, 1.0)
        # frequent tokens count more, but don't drown the others
        n = np.sqrt(counts).astype(np.float32)[word]
        z = self.mixed(x, gate)
        cost = np.bincount(word, _cost(self.refined(z, gate), bits), len(raw))
        error = (bits - 1 / (1 + np.exp(-z))) * n
        total = np.bincount(gate, n, GATES).astype(np.float32) + 50
        for k in range(ORDERS + 1):
            self.weights[:, k] += rate * np.bincount(gate, error * x[k], GATES).astype(np.float32) / total
        cell = gate * np.int32(33) + np.rint((z + 12) / 0.75).astype(np.int32)
        ones, seen = (np.bincount(cell, w, GATES * 33).reshape(GATES, 33) for w in (n * bits, n))
        prior = 1 / (1 + np.exp(-np.linspace(-12, 12, 33)[None, :]))
        p = (ones + 20 * prior) / (seen + 20)
        self.curve += 0.1 * (np.clip(np.log(p / (1 - p)), -12, 12) - self.curve).astype(np.float32) * (seen > 0)
        return -cost

    def state(self) -> bytes:
        return np.concatenate([self.weights.ravel(), self.curve.ravel()]).astype("<f4").tobytes()

    def load(self, flat: np.ndarray) -> Mixer:
        w = self.weights.size
        self.weights, self.curve = flat[:w].reshape(self.weights.shape).astype(np.float32), flat[w:].reshape(self.curve.shape).astype(np.float32)
        return self


# ------------------------------------------------------------------ texts, word by word


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, n of them."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Code:
    """Huffman code of some tokens and, as the last symbol, the escape to all others: the nodes and
    bits of each symbol, and each node's log odds over all classes and in each. ``by``: symbols x classes."""

    def __init__(self, by: np.ndarray):
        leaves = len(by)
        order = np.argsort(by.sum(1), kind="stable")
        weights, parent, side = by.sum(1)[order].tolist(), [0] * (2 * leaves - 1), [0] * (2 * leaves - 1)
        i, j = 0, leaves
        for m in range(leaves, 2 * leaves - 1):
            total = 0.0
            for bit in (0, 1):
                if i < leaves and (j >= m or weights[i] <= weights[j]):
                    k, i = i, i + 1
                else:
                    k, j = j, j + 1
                parent[k], side[k] = m, bit
                total += weights[k]
            weights.append(total)
        up, sides, at, leaf = np.array(parent), np.array(side, np.int8), np.arange(leaves), order
        found: list[tuple] = []
        while len(left := np.flatnonzero(at < 2 * leaves - 2)):
            at, leaf = at[left], leaf[left]
            found.append((leaf, up[at] - leaves, sides[at]))
            at = up[at]
        leaf, node, bit = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ([],) * 3))
        by_leaf = np.argsort(leaf, kind="stable")
        self.size = np.bincount(leaf.astype(np.int64), minlength=leaves)
        self.start = np.cumsum(self.size) - self.size
        self.node, self.bit = node[by_leaf].astype(np.int32), bit[by_leaf].astype(np.int8)
        edge, of = node * 2 + bit, by[leaf.astype(np.int64)]
        n = np.stack([np.bincount(edge.astype(np.int64), of[:, k], 2 * max(leaves - 1, 1)) for k in range(by.shape[1])]).reshape(by.shape[1], -1, 2)
        whole = n.sum(0) + 0.05
        half = whole / whole.sum(1, keepdims=True)
        self.half0, self.half1 = (np.ascontiguousarray(half[:, k], np.float32) for k in (0, 1))
        own = n + 4 * half
        self.odds = np.log(whole[:, 1] / whole[:, 0]).astype(np.float32)
        self.by_class = (np.log(own[..., 1] / own[..., 0]).astype(np.float32) - self.odds).ravel()
        self.nodes = len(self.odds)


class Reader:
    """Reads texts in order, as symbols of a code, and mixes each bit's predictors: the symbol's frequency,
    that in the class the text so far speaks for, and what followed the last word and the last two
    words. After each ``STEP`` words the weights move by the errors; with ``learn`` the weights and
    counts are those of all texts, else each text has weights of its own, which start from the learned."""

    def __init__(self, code: Code, costs: np.ndarray, prior: np.ndarray, counts: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.code, self.costs, self.prior = code, np.asfortranarray(costs), prior
        self.counts = np.zeros((2 << PAIRS, 2), np.int32) if counts is None else counts
        self.weights = np.tile(np.array([1, 0.6, 0.4, 0.4], np.float32), (READS, 1)) if weights is None else weights

    @staticmethod
    def _follows(context: np.ndarray, node: np.ndarray, table: int) -> np.ndarray:
        """Where the counts of a node's zeros are, behind a context; those of its ones are next."""
        x = context + node.view(np.uint32) * _N1
        x ^= x >> np.uint32(15)
        x *= _N2
        x ^= x >> np.uint32(13)
        x *= _N3
        x >>= np.uint32(32 - PAIRS)
        x += np.uint32(table << PAIRS)
        x <<= np.uint32(1)
        return x.view(np.int32)

    def read(self, symbols: np.ndarray, sizes: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of each text's symbols, log10 of its trust in each class). ``sizes``: symbols a text."""
        code, first, flat = self.code, np.cumsum(sizes) - sizes, self.counts.reshape(-1)
        ids = symbols.astype(np.uint32) + np.uint32(2)
        last, last2 = np.concatenate([[1], ids[:-1]]).astype(np.uint32), np.concatenate([[0, 0], ids[:-2]]).astype(np.uint32)[: len(ids)]
        last[first], last2[first] = 1, 0
        last2[(first + 1)[sizes > 1]] = 1
        one, two = last * _N2, (last2 * _N3 ^ (last2 * _N3 >> np.uint32(16))) * _N1 + last * _N2
        total, trust = np.zeros(len(sizes)), np.tile(np.log10(self.prior), (len(sizes), 1))
        weights = self.weights if learn else np.tile(self.weights, (len(sizes), 1))
        rate, calm = (np.float32(0.3), 200) if learn else (np.float32(RATE), CALM)
        for b in range(0, int(sizes.max(initial=0)), STEP):
            lanes = np.flatnonzero(sizes > b)
            n = np.minimum(sizes[lanes] - b, STEP)
            lane, at = np.repeat(lanes, n), _ragged(first[lanes] + b, n)
            s = symbols[at]
            size = code.size[s]
            bits = _ragged(code.start[s], size)
            node, bit = code.node[bits], code.bit[bits]
            owner = np.repeat(lane, size)
            slots = [self._follows(np.repeat(c[at], size), node, k) for k, c in enumerate((one, two))]
            half0, half1 = code.half0.take(node), code.half1.take(node)
            x = [code.odds.take(node), code.by_class.take((trust.argmax(1) * code.nodes).take(owner) + node)]
            gate = np.zeros(len(node), np.int64) if learn else owner * READS
            for slot, much in zip(slots, (4, 1), strict=True):
                c0, c1 = flat.take(slot).astype(np.float32), flat.take(slot + np.int32(1)).astype(np.float32)
                seen = c0 + c1
                for least in _SEEN:  # how well known the context is: never, once or twice, rarely, often
                    gate += (seen >= least) * much
                c0 += half0
                c1 += half1
                c1 /= c0
                x.append(np.log(c1, out=c1) - x[0])
            z = np.zeros(len(node), np.float32)
            for row, w in zip(x, weights.T, strict=True):
                z += row * w.take(gate)
            np.clip(z, -20, 20, out=z)
            total -= np.bincount(owner, _cost(z, bit), len(sizes)) * math.log10(2)
            error = bit - 1 / (1 + np.exp(-z))
            met = np.bincount(gate, minlength=len(weights)) + calm
            for k, row in enumerate(x):
                weights[:, k] += rate * np.bincount(gate, error * row, len(weights)) / met
            if learn:
                for slot in slots:
                    np.add.at(flat, slot + bit, np.int32(1))
            for k, cost in enumerate(self.costs.T):
                trust[:, k] += np.bincount(lane, cost.take(s), len(sizes))
        top = trust.max(1, keepdims=True)
        return total, trust - top - np.log10(np.power(10, trust - top).sum(1, keepdims=True))


_SEEN = (1, 3, 16)


def _symbols(found: list[list[str]], find) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all tokens of some texts in the table of frequent ones, and tokens a text."""
    sizes = np.array([len(f) for f in found])
    return np.fromiter(map(find, chain.from_iterable(found)), np.int64, sizes.sum()), sizes


def _coded(rows: np.ndarray, escape: int) -> np.ndarray:
    """Symbols of rows: the first ``escape`` have one of their own."""
    return np.where((rows < 0) | (rows > escape), escape, rows).astype(np.int64)


def _read_training(frequent, model):
    """A task's counts of what follows words, as blocks; its weights as block -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, read, seen = _Rows(frequent.value[0]).__getitem__, Reader(*model.value), 0
        escape = len(read.costs) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                rows, sizes = _symbols([tokens(t.as_py()) for t in batch.column("text").slice(at, TEXTS)], find)
                read.read(_coded(rows, escape), sizes, learn=True)
                seen += len(rows)
        if seen:
            for block, part in enumerate(np.array_split(read.counts.astype(np.float32), BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])
            state = np.append(read.weights.ravel() * seen, seen).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["block", "counts"])

    return run


# ------------------------------------------------------------------ passes over the tables


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, class, count) over training documents; held-out ones' tokens with count 0."""
    known: list[Counter] = [Counter() for _ in range(CLASSES)]
    unseen: set[str] = set()

    def emit() -> Iterator[pa.RecordBatch]:
        for k, counts in enumerate(known):
            yield _counted(list(counts), k, list(counts.values()))
            counts.clear()
        yield _counted(list(unseen), 0, [0] * len(unseen))
        unseen.clear()

    for batch in batches:
        for text, k, out in zip(batch.column("text"), batch.column("class").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
            if out:
                unseen.update(tokens(text.as_py()))
            else:
                known[k].update(tokens(text.as_py()))
            if sum(map(len, known)) + len(unseen) > HELD:
                yield from emit()
    yield from emit()


def _counted(words: list[str], k: int, counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.full(len(words), k, np.int32)), pa.array(counts, pa.int64())], ["token", "class", "c"])


class Chunk:
    """Tokens with their counts, spelled in pieces: ``raw``, each of a token ``of``."""

    def __init__(self, words: list[str], counts: np.ndarray, by: np.ndarray):
        self.words, self.counts, self.by = words, counts, by
        found = [spelling(w) for w in words]
        self.raw = [x for xs in found for x in xs]
        self.of = np.repeat(np.arange(len(words)), [len(xs) for xs in found])

    def parts(self) -> Iterator[tuple[slice, list[bytes]]]:
        """The pieces, at most ``BYTES`` bytes at a time (one piece at least)."""
        at = 0
        while at < len(self.raw):
            end, held = at, 0
            while end < len(self.raw) and (end == at or held + len(self.raw[end]) <= BYTES):
                held += len(self.raw[end])
                end += 1
            yield slice(at, end), self.raw[at:end]
            at = end


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Chunk]:
    for batch in batches:
        for at in range(0, batch.num_rows, words):
            part = batch.slice(at, words)
            by = np.column_stack([part.column(f"c{k}").to_numpy().astype(np.float64) for k in range(CLASSES)])
            yield Chunk(part.column("token").to_pylist(), part.column("c").to_numpy().astype(np.float64), by)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, as one block of bytes a range of the table."""
    table = np.zeros((OFFSETS[-1], 2), np.float32)
    for chunk in _chunks(batches, 4 * WORDS):
        for at, raw in chunk.parts():
            count_bits(raw, chunk.counts[chunk.of[at]], table)
    for block, part in enumerate(np.array_split(table, BLOCKS)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])


def _sum_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of several tasks -> one block a range; a task holds its ranges of the table."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(raw.as_py(), np.float32)
            sums[block] = sums[block] + part if block in sums else part
    for block, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])


def _learn(table, all_c: float, all_by: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, steps, weight, gained = Mixer(), 0, 0.0, np.array([5.0, 2.0, 3.0])
        for chunk in _chunks(batches, WORDS):
            bits = np.zeros(len(chunk.words))
            for at, raw in chunk.parts():
                of = chunk.of[at]
                bits += np.bincount(of, mixer.learn(raw, chunk.counts[of], table.value, 0.5 / (1 + steps) ** 0.25), len(bits))
            spelled = np.exp2(np.maximum(bits, -300))[:, None]
            if steps:  # shares: an online step of expectation maximisation, left out alike
                parts = np.stack([np.maximum(chunk.by - 1, 0) / np.maximum(all_by - 1, 1), np.repeat(np.maximum(chunk.counts - 1, 0)[:, None] / max(all_c - 1, 1), CLASSES, 1), np.repeat(spelled, CLASSES, 1)])
                parts *= (gained / gained.sum())[:, None, None]
                gained += (parts / parts.sum(0) * chunk.by).sum((1, 2))
            steps, weight = steps + 1, weight + len(chunk.words)
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array([mixer.state()], pa.binary()), pa.array([weight]), pa.array([gained.tolist()], pa.list_(pa.float64()))], ["state", "weight", "gained"])

    return run


def _score_tokens(table, mixer: Mixer, n: int, v: int, all_by: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b, c), odds = mixer.shares, Odds(table.value)
        for chunk in _chunks(batches, WORDS):
            bits, counts, by = np.zeros(len(chunk.words)), chunk.counts, chunk.by
            for at, raw in chunk.parts():
                bits += np.bincount(chunk.of[at], mixer.log2(raw, odds), len(bits))
            # by classes; in logarithms, as spellings of long tokens underflow
            spelled = (bits * math.log(2) + math.log(c))[:, None]
            with np.errstate(divide="ignore"):
                own = np.log(a * by / np.maximum(all_by, 1) + b * counts[:, None] / max(n, 1))
            cost = np.logaddexp(own, spelled) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.words), pa.array(counts.astype(np.int64)), pa.array(np.log10((counts + 1) / (n + v + 1))), *map(pa.array, np.ascontiguousarray(cost.T)), *map(pa.array, np.ascontiguousarray(by.T))], ["token", "c", "base", *_COSTS, *_BY])

    return run


_COSTS, _BY = [f"s{k}" for k in range(CLASSES)], [f"c{k}" for k in range(CLASSES)]
_READ = ["read", *(f"t{k}" for k in range(CLASSES))]
_NAMES = ["row", "doc_id", "held_out", "n_bytes", "token", "tf", "seen", "base", *_COSTS, *_READ]
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.float64()] * (2 * CLASSES + 1)]
_ROWS = "row long, doc_id long, held_out boolean, n_bytes long, token string, tf long, seen long, base double, " + ", ".join(f"{c} double" for c in (*_COSTS, *_READ))


class _Rows(dict):
    """Token -> its row in the table of frequent tokens; -1 for all others."""

    def __missing__(self, token: str) -> int:
        return -1


def _sum_documents(frequent, model, rest: np.ndarray):
    """Per document the score of its symbols, its trust in each class, and sums over frequent tokens
    (token null); and a row per other token. ``rest``: log10 of what all escaped tokens have, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, values = frequent.value  # token -> row of (known?, base, costs)
        find, read = _Rows(number).__getitem__, Reader(*model.value)
        escape = len(read.costs) - 1
        row, none = TaskContext.get().partitionId() << 40, (0, 0.0, *[0.0] * CLASSES, *[0.0] * (CLASSES + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out: list[tuple] = []
                texts = [tokens(t.as_py()) for t in part.column("text")]
                every, sizes = _symbols(texts, find)
                symbols = _coded(every, escape)
                read_as, trust = read.read(symbols, sizes)
                first = np.cumsum(sizes) - sizes
                for k, (doc, found, held) in enumerate(zip(part.column("doc_id").to_pylist(), texts, part.column("held_out").to_pylist(), strict=True)):
                    row += 1
                    rows = every[first[k] : first[k] + sizes[k]]
                    known = rows >= 0
                    if not known.all():
                        out += [(row, doc, held, 0, t, tf, *none) for t, tf in Counter([found[i] for i in np.flatnonzero(~known)]).items()]
                    sums = values[rows[known], :2].sum(0)
                    escaped = symbols[first[k] : first[k] + sizes[k]] == escape
                    costs = values[rows[known & escaped], 2:].sum(0) - escaped.sum() * rest
                    out.append((row, doc, held, sum(map(len, found)) + len(found), None, len(found), int(sums[0]), sums[1], *costs.tolist(), read_as[k], *trust[k].tolist()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

    return run


def _classes(docs: DataFrame):
    """The class of a document as a column: its lang's place among the most frequent."""
    if "lang" not in docs.columns:
        return F.lit(0)
    found = docs.filter(~held_out("doc_id")).filter("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(CLASSES - 1).collect()
    out = F.lit(CLASSES - 1)
    for k, r in enumerate(found):
        out = F.when(F.col("lang").cast("string") == r.lang, k).otherwise(out)
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = prepare(docs.sparkSession)
    sc = spark.sparkContext
    marked = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"), _classes(docs).alias("class"))
    counted = marked.select("text", "held_out", "class").mapInArrow(_count_tokens, "token string, class int, c long")
    of_class = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(CLASSES)]
    vocabulary = materialise(counted.groupBy("token").agg(F.sum("c").alias("c"), *of_class).sortWithinPartitions(F.xxhash64("token"), "token"), "vocabulary")
    n, v, *by = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), *(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(CLASSES))).first()
    all_by = np.array(by, float)
    train = vocabulary.filter("c > 0")
    # one block a range of a table of fixed size
    blocks = train.mapInArrow(_count_slots, "block int, counts binary").repartition(BLOCKS, "block").mapInArrow(_sum_slots, "block int, counts binary")
    filled = np.zeros((OFFSETS[-1], 2), np.float32)
    ranges = np.array_split(filled, BLOCKS)
    for r in blocks.collect():
        ranges[r.block][:] = np.frombuffer(r.counts, np.float32).reshape(-1, 2)
    table = sc.broadcast(filled)
    mixer = Mixer()
    learned = train.mapInArrow(_learn(table, float(n), all_by), "state binary, weight double, gained array<double>").collect()
    if learned:
        mixer.load(np.average([np.frombuffer(r.state, "<f4") for r in learned], axis=0, weights=[r.weight for r in learned]))
        gained = np.sum([r.gained for r in learned], axis=0)
        mixer.shares = np.maximum(gained / gained.sum(), 0.005)
        mixer.shares /= mixer.shares.sum()
    costs = ", ".join(f"{c} double" for c in (*_COSTS, *_BY))
    scored = materialise(vocabulary.mapInArrow(_score_tokens(table, mixer, n, v, all_by), f"token string, c long, base double, {costs}"), "token-scores")
    # by a threshold on counts, so that tasks send FREQUENT rows in all, not each
    step = F.floor(F.log2("c") * 8).cast("int")
    short = scored.filter((F.col("c") > 0) & (F.length("token") <= 64)).withColumn("step", step)
    least, held = 1 << 30, 0
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.step):
        held += r.n
        if held > FREQUENT:
            break
        least = r.step
    most = short.filter(F.col("step") >= least).drop("step").toArrow().to_pydict()
    values = np.column_stack([np.array(most["c"]) > 0, most["base"], *(most[c] for c in _COSTS)]).astype(float)
    order = sorted(range(len(values)), key=lambda i: (-most["c"][i], most["token"][i]))  # the first have a code
    values = values[order]
    frequent = sc.broadcast(({most["token"][i]: k for k, i in enumerate(order)}, values))
    prior = (all_by + 1) / (all_by + 1).sum()
    coded = np.column_stack([most[c] for c in _BY]).astype(float)[order[:CODED]].reshape(-1, CLASSES)
    code = Code(np.vstack([coded, np.maximum(all_by - coded.sum(0), 0) + 1 / CLASSES]))
    # by class: what the tokens with a code have together, and what is left to all others
    own = np.power(10.0, values[:CODED, 2:])
    rest = np.log10(np.maximum(1 - own.sum(0), 1e-12))
    costs = np.vstack([values[:CODED, 2:], rest])
    start = sc.broadcast((code, costs, prior))
    # as many tasks as texts need or the cluster runs at once, as each has counts of its own
    size = vocabulary.agg(F.coalesce(F.sum(F.col("c") * (F.octet_length("token") + 1)), F.lit(0))).first()[0]
    texts = marked.filter(~F.col("held_out")).select("text").coalesce(max(sc.defaultParallelism, size // PER_TASK + 1))
    made = materialise(texts.mapInArrow(_read_training(frequent, start), "block int, counts binary"), "read-counts")
    follows = np.zeros((2 << PAIRS, 2), np.float32)
    ranges = np.array_split(follows, BLOCKS)
    for r in made.filter("block >= 0").repartition(BLOCKS, "block").mapInArrow(_sum_slots, "block int, counts binary").collect():
        ranges[r.block][:] = np.frombuffer(r.counts, np.float32).reshape(-1, 2)
    # as 16 bits, in proportion
    follows *= np.minimum(1, 65535 / np.maximum(follows.max(1, keepdims=True), 1))
    states = [np.frombuffer(r.counts, np.float32).astype(float) for r in made.filter("block = -1").collect()]
    weights = (np.sum([x[:-1] for x in states], 0) / sum(x[-1] for x in states)).astype(np.float32).reshape(READS, -1) if states else None
    model = sc.broadcast((code, costs, prior, follows.astype(np.uint16), weights))
    rows = materialise(marked.select("doc_id", "text", "held_out").mapInArrow(_sum_documents(frequent, model, rest), _ROWS), "document-sums")
    discard(made)
    rare = rows.filter("token is not null").select("row", "token", "tf").join(scored.drop(*_BY), "token")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("r_seen"), *(F.sum(F.col("tf") * F.col(c)).alias(f"r_{c}") for c in ("base", *_COSTS)))
    add = lambda a: (F.col(a) + F.coalesce(F.col(f"r_{a}"), F.lit(0))).alias(a)
    heads = rows.filter("token is null").drop("token").join(rare, "row", "left").select("doc_id", "held_out", "n_bytes", "tf", *_READ, *map(add, ("seen", "base", *_COSTS)))
    each = [F.col(c) + F.col(t) for c, t in zip(_COSTS, _READ[1:], strict=True)]
    top = F.greatest(*each)
    score = F.col("read") + top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in each), F.lit(0.0)))
    return heads.select("doc_id", "held_out", F.col("tf").alias("n_tokens"), F.col("seen").cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), (-F.log2(F.lit(10.0)) * score / F.col("n_bytes")).alias("bits_per_byte"))
