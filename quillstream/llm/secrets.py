"""Secret scanning by assignment-aware lexing.

Three base patterns find keyed assignments, access keys and long hex runs anywhere.
Beyond them, source and configuration syntax is lexed into name-literal pairs: every place
where a name meets ``=``, ``:``, ``:=`` or ``=>`` and a quoted or bare value. Constants are
propagated over the whole text: aliases (``key = other``), concatenations of strings and
names, and ``${name}`` interpolation lead from a sensitive name back to the literals that
make up its value, wherever they stand. A literal is scored by the most sensitive name it
reaches and by its own form; placeholders and words score nothing.

Defined cases: null text counts as empty; a doc_id may be null or repeated, one row
comes back per input row; an empty table gives an empty result; other columns are not read.
Names, literals and the blanks between them may have any length. Time is linear in the text:
patterns never retry inside a run that has failed, and a name is resolved once, for the most
sensitive name that leads to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.session import prepare
from .spans import Span, Taken, digest, joined

KINDS = ("assign", "access", "hex", "literal")

#: The base patterns. Letters of the keywords come in either case, ASCII only.
_KEYWORDS = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")

#: How much a part of a name says about its value.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "private": 0.5, "access": 0.5, "api": 0.5, "auth": 0.6,
    "authorization": 0.7, "client": 0.2, "key": 0.5, "signing": 0.4, "encryption": 0.4, "session": 0.3, "salt": 0.4,
    "dsn": 0.5, "connection": 0.2, "webhook": 0.5, "pat": 0.4, "pin": 0.4, "jwt": 0.8,
}
#: Names that look sensitive and are not, and values that only stand for one.
HARMLESS = {"public", "count", "length", "size", "name", "type", "id", "path", "file", "url", "limit", "max", "min", "index"}
PLACEHOLDER = re.compile(r"(?i)^(?:change[_-]?me|example|placeholder|your[_-].*|todo|none|null|true|false|undefined|x+|\*+|\.+|<.*>|test|dummy|redacted|\$\{.*\}|\$\w+|%.*%|env|os\.environ.*)$")

_PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["'\]]{0,2}[\x20\t]*+(?::=|=>|[:=])(?![=/])[\x20\t]*+""")
#: A bare value ends before the sign of the next pair in a chain (a=b=c); signs that end it
#: are padding.
_TERM = re.compile(r"""(?P<quote>["'`])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote)|(?P<bare>[A-Za-z0-9_][A-Za-z0-9+/_.~-]*+(?:=++(?![A-Za-z0-9+/_.~"'`-]))?)""")
_PLUS = re.compile(r"[\x20\t]*+(?:\+|\.\.)[\x20\t]*+")
_INTERPOLATED = re.compile(r"\$\{(\w+)\}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: A literal counts from this score on.
LEAST = 0.49


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    parts = [x.lower() for x in _PARTS.findall(name)]
    if any(x in HARMLESS for x in parts[-1:]):
        return 0.0
    return min(1.0, sum(SENSITIVE.get(x, 0.0) for x in dict.fromkeys(parts)))


def value_score(value: str) -> float:
    """0 for what isn't a secret, up to 1 for long values of mixed kinds."""
    if len(value) < 6 or PLACEHOLDER.match(value) or " " in value:
        return 0.0
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    # at least as varied as two characters that take turns, whatever the length
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return min(1.0, 0.35 + 0.2 * (kinds - 1) + 0.02 * min(len(value), 20)) if bits >= 1 else 0.0


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(name, terms): a term is (text, start, end, quoted), joined by ``+`` in the source."""
    found = []
    if "=" not in text and ":" not in text:
        return found
    for m in _PAIR.finditer(text):
        at, terms = m.end(), []
        while t := _TERM.match(text, at):
            group = "text" if t["text"] is not None else "bare"
            terms.append((t[group], t.start(group), t.end(group), group == "text"))
            at = t.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if terms:
            found.append((m["name"].rsplit(".", 1)[-1], terms))
    return found


def sensitivity(listed: list[tuple[str, list[tuple[str, int, int, bool]]]]) -> dict[str, float]:
    """Name -> the score of the most sensitive name whose value it is a part of (itself
    included). Names are visited by falling score, so each is resolved once."""
    parts: dict[str, list[str]] = {}
    for name, terms in listed:
        parts.setdefault(name, []).extend(x for value, _, _, quoted in terms for x in (_INTERPOLATED.findall(value) if quoted else [value] if _NAME.fullmatch(value) else ()))
    own = {name: name_score(name) for name in parts}
    reached: dict[str, float] = {}
    for name in sorted((x for x in own if own[x] >= 0.4), key=lambda x: -own[x]):
        todo = [name]
        while todo:
            x = todo.pop()
            if x in parts and x not in reached:
                reached[x] = own[name]
                todo += parts[x]
    return reached


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, by their own places."""
    listed = pairs(text)
    if not listed:
        return []
    defined, reached = {name for name, _ in listed}, sensitivity(listed)
    found = set()
    for name, terms in listed:
        for value, start, end, quoted in terms if name in reached else ():
            if not quoted and (value in defined or not re.search(r"[0-9]", value)):
                continue  # another name, or a word
            if value_score(value) * reached[name] >= LEAST:
                found.add((start, end))
    return [("literal", s, e) for s, e in sorted(found)]


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the lexer adds outside of them)."""
    base = base_spans(text)
    taken = Taken(base)
    return base, [x for x in literal_spans(text) if not taken.overlaps(x)]


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            base, added = secret_spans(text.as_py() or "")
            rows.append((*(sum(x[0] == k for x in base) for k in KINDS[:3]), digest(base, KINDS), joined(base + added, KINDS)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, digest and spans; no shuffle."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, _OUT)
