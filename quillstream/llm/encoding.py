"""Token ids of whole texts by the tokenizers library, with memoised pieces.

BPE never merges across the borders that a tokenizer's pre-tokeniser draws. Two kinds
draw one at single spaces whatever surrounds them: byte-level ones, which put the space in
front of the word that follows, and those that drop white space. A text is therefore cut
there, the library encodes each piece it hasn't met lately, and the pieces' ids are joined.
Texts with white space beside a space, and all texts under any other pre-tokeniser, are
encoded whole. Results equal those of encoding whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
from tokenizers import Tokenizer

#: Pieces that a task remembers, in each of two generations.
REMEMBERED = 250_000
_BESIDE = re.compile(r"^\s|\s$|\s\s")
#: ASCII marks: behind a word, a run of them is one word to both pre-tokenisers.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_LATIN_END = "\u0250"
#: Letters that byte-level pre-tokenisers put for the bytes over 127 of Latin letters:
#: the byte itself where it prints in Latin-1, else the next free one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


class Encoder:
    """Ids of texts as little-endian unsigned integers in bytes, as the library encodes them
    with its default settings: a special token spelled out in a text is that token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kinds = json.loads(self.tokenizer.to_str())
        self.mode = self._mode(kinds.get("pre_tokenizer") or {}, kinds.get("normalizer"))
        added = [re.escape(x["content"]) for x in kinds.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None
        self.tokenize = self.tokenizer.model.tokenize
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line = self._word("\u010a") if self.mode == "leading" else b""

    def __enter__(self) -> Encoder:
        return self

    def __exit__(self, *_) -> None:
        """A task's end: the worker lives on, what it remembers doesn't."""
        self.new, self.old, self.marks = {}, {}, {}

    @staticmethod
    def _mode(pre: dict, normalizer: dict | None) -> str:
        parts = pre.get("pretokenizers", [pre])
        if normalizer is None and len(parts) == 1 and parts[0].get("type") == "ByteLevel" and not parts[0]["add_prefix_space"] and parts[0]["use_regex"]:
            return "leading"
        steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [normalizer or {}])]
        split, last = parts[0], parts[-1]
        if set(steps) <= {"NFC", "Replace", "Lowercase"} and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and split.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and len(parts) == 2 and last.get("type") == "ByteLevel" and not last["add_prefix_space"] and not last["use_regex"]:
            return "dropped"
        return "whole"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _split(self, text: str) -> list[str] | None:
        """Pieces at spaces, the first one without a space before it. A single line break
        between words is a word of its own: it starts the piece behind it. None: not here."""
        if self.added is not None and self.added.search(text):
            return None
        if self.mode == "leading" and not _BESIDE.search(text):
            return text.replace("\n", " \n").split(" ")
        if self.mode == "dropped":
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            if text.isascii():
                text = text.lower()
            return text.split(" ")
        return None

    def _word(self, word: str) -> bytes:
        """Ids of one word of the pre-tokeniser, in its alphabet."""
        return array(self.code, [t.id for t in self.tokenize(word)]).tobytes()

    def _piece(self, piece: str, lead: str) -> bytes:
        """Ids of a piece: the library's normaliser, pre-tokeniser and model in turn.

        Latin letters, with or without marks of punctuation at their end, are words to
        both pre-tokenisers, so what the first two steps make of them is known."""
        if piece.startswith("\n") and self.line:
            return self.line + self._piece(piece[1:], "")
        word = piece.rstrip(_MARKS)
        lower = word.lower() if self.mode == "dropped" else word
        if lower.isalpha() and max(lower) < _LATIN_END:
            tail = b""
            if len(word) < len(piece):
                mark = piece[len(word) :]
                tail = self.marks.get(mark)
                if tail is None:
                    tail = self._word(mark)
                    if len(self.marks) > 50_000:
                        self.marks.clear()
                    self.marks[mark] = tail
            known = (lead or self.mode == "dropped") and (tail or lower is not word)
            ids = (self.new.get(lower) or self.old.get(lower)) if known else None
            if ids is None:
                ids = self._word((lead and "\u0120") + (lower if lower.isascii() else lower.encode().decode("latin-1").translate(_BYTES)))
                if known:
                    self.new[lower] = ids
            return ids + tail
        text = lead + piece
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return b"".join(self._word(w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        lead = " " if self.mode == "leading" else ""
        new, old, out = self.new, self.old, []
        for text in texts:
            pieces = self._split(text)
            if pieces is None:
                out.append(self._whole(text))
                continue
            head = b""
            if lead:  # the first piece has no space in front
                head = self._piece(pieces[0], "") if pieces[0] else b""
                del pieces[0]
            found = list(map(new.get, pieces))
            if None in found:
                for i in [i for i, x in enumerate(found) if x is None]:
                    piece = pieces[i]
                    ids = new.get(piece)
                    if ids is None:
                        ids = old.get(piece)
                        if ids is None:
                            ids = self._piece(piece, lead)
                        new[piece] = ids
                    found[i] = ids
            out.append(head + b"".join(found))
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
