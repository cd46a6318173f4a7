"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause become symbols, and small transducers over these, composed into one
machine, weigh them:

* lexicon: words, stems and phrases of several words to symbols (insult, threat, target,
  negator, reporter, intent, copula, intensifier, other) with weights, the longest phrase first;
* insult: patterns of several words, a target with a copula ("you are such a ...") or an
  intensifier before it, raise an insult;
* threat: intent, a violent verb and its object are one pattern; the verb alone is faint, the
  object behind it adds what the verb left open;
* negation: for a few words after a negator, insults and threats lose most of their weight;
* reported speech: after a reporting verb, or inside quotes, they lose some;
* target: a second or third person near by raises them.

Each of them is a table of (state, symbol) -> (state, factor, addend); ``compose`` builds the
product machine once (factors multiply, addends count under all factors), so a clause costs
one step a word. Only clauses with an insult or a threat are read: an Aho-Corasick automaton
over the lexicon finds them in one pass of the text.

The lexicon's insult weights are learned from the labels: words, and stems that several words
share, whose presence in a bounded, hash-chosen sample of labelled rows (about ``SAMPLE`` rows)
tells toxic from clean. Only words of ``LETTERS`` letters are learned, and stems of ``STEM`` to
``LONGEST`` letters; that bounds what is counted, all words are read when scoring. A few
published everyday words stand in before any label is seen. A logistic model over the clause
weights of the same sample turns them into a score. Held-out documents (crc32 of doc_id mod 5
is 0) are never learned from. Slopes are held at zero or above; where labelled texts show no
threats, a threat with intent and object keeps log odds of its own (``SPOKEN``). Neither language, source, labels nor doc_id are
inputs of a score.

Defined cases: null and empty texts get the score of a text without any match; labels that are
null, or of unknown documents, teach nothing; a document with several labels is toxic if one
says so; repeated rows and rows with a null doc_id are scored alike (a null id isn't held
out); without labels of both kinds the prior lexicon and fixed coefficients score; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import discard, materialise, prepare

#: Labelled rows that lexicon and coefficients are learned from, about.
SAMPLE = 20_000
#: Learned lexemes at most (strongest first); letters of learned words, and of learned stems.
LEXEMES = 400
LETTERS = (3, 30)
STEM, LONGEST = 4, 8
#: Share of the toxic sample that a lexeme must occur in: more than a group of copies.
SUPPORT = 0.02

OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORTER, QUOTE, INTENT, COPULA, STRONG = range(10)
SYMBOLS = 10
#: Symbols whose weight or addend negation and reported speech lessen.
WEIGHED = (INSULT, THREAT, TARGET)

#: Everyday words and phrases of four languages, by their role.
PRIOR_INSULTS = "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool imbecile dummkopf trottel abschaum imbécile crétin ordure estúpido imbécil basura".split()
THREATS = "kill hurt destroy beat punch stab shoot burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
INSULT_PHRASES = ("piece of trash", "piece of garbage", "waste of space", "good for nothing", "shut up", "ta gueule", "halt die fresse", "cállate la boca")
THREAT_PHRASES = ("drop dead", "go die", "beat up", "hunt down", "burn in hell", "come after")
TARGETS = "you your yours yourself he she they him her them his their du dich dir dein ihr euch sie tu te toi vous votre ils elles tú ti usted ustedes ellos ellas".split()
NEGATORS = "not no never nobody nothing without isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun sin nunca jamás".split()
REPORTERS = "said says say quoted quote wrote writes claimed reported called alleged sagte schrieb zitierte dit disait écrit dijo escribió".split()
INTENTS = "will shall gonna going must should want i'll we'll you'll werde werden wirst will sollte vais vas va allons voy vas vamos quiero".split()
COPULAS = "are is am was were be you're he's she's they're bist ist sind seid es êtes est sont eres es son".split()
INTENSIFIERS = "so such very total totally complete absolute really fucking utter utterly so total völlig tel très vraiment total muy tan".split()
ROLES = dict.fromkeys(INTENSIFIERS, STRONG) | dict.fromkeys(COPULAS, COPULA) | dict.fromkeys(INTENTS, INTENT) | dict.fromkeys(TARGETS, TARGET) | dict.fromkeys(NEGATORS, NEGATOR) | dict.fromkeys(REPORTERS, REPORTER)

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_END = re.compile(r"[.!?;:\n]")

Machine = dict[tuple[int, int], tuple[int, float, float]]


def negation(reach: int = 3, factor: float = 0.25) -> Machine:
    """State: words that a negator still covers."""
    out = {}
    for s, x in product(range(reach + 1), range(SYMBOLS)):
        out[s, x] = (reach if x == NEGATOR else max(0, s - 1), factor if s and x in WEIGHED else 1.0, 0.0)
    return out


def reported(factor: float = 0.5) -> Machine:
    """State 1 after a reporting verb; 2 inside quotes; a closing quote ends both."""
    out = {}
    for s, x in product(range(3), range(SYMBOLS)):
        to = {QUOTE: 0 if s == 2 else 2, REPORTER: max(s, 1)}.get(x, s)
        out[s, x] = (to, factor if s and x in WEIGHED else 1.0, 0.0)
    return out


def targeted(reach: int = 4, insult: float = 1.3, threat: float = 2.0) -> Machine:
    """State: words that a target still covers."""
    out = {}
    for s, x in product(range(reach + 1), range(SYMBOLS)):
        f = {INSULT: insult, THREAT: threat}.get(x, 1.0) if s else 1.0
        out[s, x] = (reach if x == TARGET else max(0, s - 1), f, 0.0)
    return out


def insulting(reach: int = 3, said: float = 1.4, strong: float = 1.2) -> Machine:
    """State 0; 1 behind a target; 2 to 1 + reach behind a target and a copula, with so many
    words between; 2 + reach behind an intensifier alone. An insult there is raised."""
    alone, out = 2 + reach, {}
    for s, x in product(range(alone + 1), range(SYMBOLS)):
        predicate = 2 <= s < alone
        if x == TARGET:
            to = 1
        elif x == COPULA and s == 1:
            to = alone - 1
        elif predicate:
            to = max(s - 1, 2) if x == STRONG else s - 1 if s > 2 else 0
        else:
            to = alone if x == STRONG else 0
        f = (said if predicate else strong if s == alone else 1.0) if x == INSULT else 1.0
        out[s, x] = (to, f, 0.0)
    return out


def threatening(reach: int = 3, bare: float = 0.3, meant: float = 1.0, aimed: float = 1.0) -> Machine:
    """States 1 to reach: words that an intent still covers; above: words in which the object
    of a threat may follow, which then adds ``aimed``. A threat without intent is faint."""
    out = {}
    for s, x in product(range(2 * reach + 1), range(SYMBOLS)):
        waiting = s > reach
        if x == THREAT:
            to = 2 * reach
        elif x == TARGET and waiting:
            to = 0
        elif x == INTENT:
            to = reach
        else:
            to = s - 1 if s > reach + 1 or 0 < s <= reach else 0
        out[s, x] = (to, (meant if 0 < s <= reach else bare) if x == THREAT else 1.0, aimed if x == TARGET and waiting else 0.0)
    return out


def compose(*machines: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product machine reachable from all zeros: next state, factor and addend by symbol."""
    states, todo = {(0,) * len(machines): 0}, [(0,) * len(machines)]
    rows: list[list[tuple[int, float, float]]] = []
    while len(rows) < len(todo):
        at, row = todo[len(rows)], []
        for x in range(SYMBOLS):
            steps = [m[s, x] for m, s in zip(machines, at, strict=True)]
            to = tuple(s for s, _, _ in steps)
            if to not in states:
                states[to] = len(todo)
                todo.append(to)
            factor = math.prod(f for _, f, _ in steps)
            row.append((states[to], factor, factor * sum(a for _, _, a in steps)))
        rows.append(row)
    return tuple(np.array([[step[k] for step in r] for r in rows]) for k in range(3))


PARTS = (negation(), reported(), targeted(), insulting(), threatening())


def phrases() -> dict[str, list[tuple[tuple[str, ...], int]]]:
    """First word -> (words, symbol) of the phrases that start with it, the longest first."""
    out: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for listed, symbol in ((INSULT_PHRASES, INSULT), (THREAT_PHRASES, THREAT)):
        for x in listed:
            words = tuple(x.split())
            out.setdefault(words[0], []).append((words, symbol))
    return {k: sorted(v, key=lambda x: -len(x[0])) for k, v in out.items()}


@dataclass
class Grammar:
    """The composed machine with a lexicon; ``words`` and ``stems`` have log weights."""

    words: dict[str, float]
    stems: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [-2.0, 1.5, 0.5, 0.5, 0.5])

    def __post_init__(self) -> None:
        self.to, self.factor, self.addend = (x.tolist() for x in _MACHINE)
        self._matcher = None

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        if self._matcher is None:
            a = ahocorasick.Automaton()
            for x in {*self.words, *self.stems, *THREATS, *INSULT_PHRASES, *THREAT_PHRASES}:
                a.add_word(x, len(x))
            a.make_automaton()
            self._matcher = a
        return self._matcher

    def symbol(self, word: str) -> tuple[int, float]:
        if (w := self.words.get(word)) is not None:
            return INSULT, w
        for n in range(STEM, min(len(word), LONGEST + 1) + 1):
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        if word in _THREATS:
            return THREAT, 1.0
        if word in '"“”«»':
            return QUOTE, 0.0
        return ROLES.get(word, OTHER), 0.0

    def symbols(self, text: str) -> list[tuple[int, float]]:
        """The lexicon's output for a clause, lower-cased: phrases first, then words."""
        words, out, i = _WORD.findall(text), [], 0
        while i < len(words):
            found = next(((p, x) for p, x in _PHRASES.get(words[i], ()) if tuple(words[i : i + len(p)]) == p), None)
            out.append((found[1], 2.0 if found[1] == INSULT else 1.0) if found else self.symbol(words[i]))
            i += len(found[0]) if found else 1
        return out

    def clause(self, text: str) -> tuple[float, float]:
        """(insult weight, threat weight) of one clause, lower-cased."""
        state, insult, threat = 0, 0.0, 0.0
        for symbol, weight in self.symbols(text):
            if symbol == INSULT:
                insult += self.factor[state][symbol] * weight
            elif symbol == THREAT:
                threat += self.factor[state][symbol] * weight
            threat += self.addend[state][symbol]
            state = self.to[state][symbol]
        return insult, threat

    def features(self, text: str) -> list[float]:
        """Of a whole text: insult weight, that of its heaviest threat (faint ones don't add up),
        matched clauses, heaviest clause."""
        text = text.lower()
        insult = threat = heaviest = 0.0
        clauses, end = 0, -1
        for at, n in self.matcher().iter(text):
            first = at - n + 1
            if at < end or (first and text[first - 1].isalpha()):
                continue
            # what lies before the last clause's end has been read
            start = max(max(text.rfind(c, max(end, 0), first) for c in ".!?;:\n") + 1, end, 0)
            m = _END.search(text, at)
            end = m.end() if m else len(text)
            a, b = self.clause(text[start:end])
            insult, threat, clauses, heaviest = insult + a, max(threat, b), clauses + (a + b > 0), max(heaviest, a + b)
        return [math.log1p(insult), math.log1p(threat), math.log1p(clauses), math.log1p(heaviest)]

    def score(self, text: str | None) -> float:
        f = self.features(text or "")
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], f, strict=True))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


_THREATS = frozenset(THREATS)
_MACHINE = compose(*PARTS)
_PHRASES = phrases()


def held_out(doc_id):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts -> (lexeme, stem?, toxic, clean): documents that have it."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def emit() -> pa.RecordBatch:
        keys = [*{**counts[0], **counts[1]}]
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, ["lexeme", "stem", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = {w for w in _WORD.findall((text.as_py() or "").lower()) if LETTERS[0] <= len(w) <= LETTERS[1]}
            own = counts[int(y)]
            own.update((w, False) for w in words)
            own.update({(w[:n], True) for w in words for n in range(STEM, min(len(w), LONGEST + 1))})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield emit()
    if counts[0] or counts[1]:
        yield emit()


def lexicon(rows: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems from how many toxic and clean documents have them.

    A stem stands for its words where it is as telling as they are; a word that isn't
    one of its continuations' only form is left to the stem."""
    words, stems, kept = {}, {}, {}
    for x, stem, a, b in rows:
        kept[x, stem] = (a, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)))
    for (x, stem), (a, w) in sorted(kept.items(), key=lambda y: (len(y[0][0]), y[0])):
        if any(x[:n] in stems for n in range(STEM, len(x) + (not stem))):
            continue
        if stem:
            forms = [k for k in ((y, s) for y, s in kept if not s and y.startswith(x) and len(y) > len(x))]
            # one form only: the word itself says as much
            if len(forms) < 2 and any(kept[k][0] >= a * 0.9 for k in forms):
                continue
            stems[x] = w
        else:
            words[x] = w
    return words, stems


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    prepare(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))
    # about ``sample`` ids, a bound that doesn't follow the data; their texts are read once
    texts = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    totals = dict.fromkeys((0, 1), 0) | {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = dict.fromkeys(PRIOR_INSULTS, 2.0)
    if not totals[0] or not totals[1]:
        discard(texts)
        return Grammar(prior, {})
    counts = texts.mapInArrow(_presence, "lexeme string, stem boolean, toxic long, clean long").groupBy("lexeme", "stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    # precise (most of its documents are toxic) and not by chance: a sign test's z over 4
    base = totals[1] / (totals[0] + totals[1])
    z = (F.col("a") - base * (F.col("a") + F.col("b"))) / F.sqrt(base * (1 - base) * (F.col("a") + F.col("b")))
    telling = counts.filter((F.col("a") >= max(3, SUPPORT * totals[1])) & (F.col("a") >= 2 * F.col("b")) & (z >= 5)).orderBy(z.desc(), "lexeme", "stem").limit(LEXEMES)
    words, stems = lexicon([tuple(r) for r in telling.collect()], totals[1], totals[0])
    grammar = Grammar(prior | words, stems)
    found = texts.mapInArrow(_feature_rows(grammar), "f array<double>, y int").groupBy("f", "y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("f", "y"), "f", "y").limit(2 * sample).collect()
    if found:
        grammar.coefficients = fitted(grammar, *(np.array([r[c] for r in found], float) for c in ("f", "y", "n")))
    discard(texts)
    return grammar


def _feature_rows(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [[round(x, 3) for x in grammar.features(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["f", "y"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a ridge that draws the slopes to those
    of ``prior``. No evidence speaks against toxicity: slopes that would be negative are left out."""
    used = list(range(x.shape[1]))
    while True:
        a = np.column_stack([np.ones(len(x)), x[:, used]])
        to, r = np.concatenate([[0.0], prior[used]]), np.array([1e-6, *[ridge] * len(used)])
        c = np.zeros(len(to))
        loss = lambda c, a=a, to=to, r=r: (n * (np.logaddexp(0, a @ c) - y * (a @ c))).sum() + (r * (c - to) ** 2).sum() / 2
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + np.diag(r), a.T @ (n * (y - p)) - r * (c - to))
            while loss(c + step) > loss(c) and np.abs(step).max() > 1e-9:
                step = step / 2
            c = c + step
            if np.abs(step).max() < 1e-8:
                break
        if (c[1:] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[[0, *(k + 1 for k in used)]] = c
            return out
        used = [k for k, slope in zip(used, c[1:], strict=True) if slope >= 0]


#: A threat with intent and object has these log odds where labels say nothing of threats: that is
#: where fewer labelled texts than this hold one that is more than a faint verb.
DIRECT, SPOKEN, SHOWN = "i will kill you", 1.0, 30


def fitted(grammar: Grammar, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
    """Coefficients of labelled features. What labels don't show keeps the grammar's own weight."""
    threat, faint = 1, math.log1p(0.9)
    shown = n[x[:, threat] > faint].sum() >= SHOWN
    if shown:
        return logistic(x, y, n, np.array([1.5, 1.5, 0.5, 0.5])).tolist()
    kept = [k for k in range(x.shape[1]) if k != threat]
    c = logistic(x[:, kept], y, n, np.array([1.5, 0.5, 0.5]))
    direct = grammar.features(DIRECT)
    others = sum(slope * direct[k] for slope, k in zip(c[1:], kept, strict=True))
    slope = max(0.0, (SPOKEN - c[0] - others) / direct[threat])
    return [float(v) for v in (c[0], c[1], slope, *c[2:])]


def _score(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([grammar.score(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no shuffle of all texts."""
    prepare(docs.sparkSession)
    grammar = learn(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(_score(grammar), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def _clean(grammar: Grammar, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t.as_py()) < 0.5 for t in batch.column(at)]))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under one half, with all their columns, in one pass."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_clean(learn(docs, labels), docs.columns.index("text")), docs.schema)
