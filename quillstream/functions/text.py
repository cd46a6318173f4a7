"""Normalisation and tokens as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that the Arabic matching form drops, and letters it unifies.
ARABIC_MARKS = "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E8\\u06EA-\\u06ED\\u0640]"
ARABIC_FROM = "آأإٱؤئىة"
ARABIC_TO = "ااااوييه"
# White space as Unicode has it, with the ASCII separators 1C to 1F.
SPACE = "\\t-\\r\\x1C-\\x20\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
#: Letters of the ``letters`` profile, for Latin-script text.
LATIN = "a-z\\u00DF-\\u00F6\\u00F8-\\u00FF"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"[{SPACE}]+", " "))


def arabic(c: Column | str) -> Column:
    """Matching form of Arabic text: no marks, unified letters, core letters only. NFC is
    not needed: what it would compose is dropped or unified to the same letter."""
    folded = F.translate(F.regexp_replace(_col(c), ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    return squeeze(F.regexp_replace(folded, f"[^\\u0621-\\u064A{SPACE}]", ""))


def letters(c: Column | str) -> Column:
    """Matching form of Latin-script text: lower-case letters only."""
    return squeeze(F.regexp_replace(F.lower(_col(c)), f"[^{LATIN} \\t-\\r]", ""))


PROFILES = {"arabic": arabic, "letters": letters}
#: White space that is left in a matching form before runs of it are squeezed.
_BLANK = "[ \\t-\\r]"


def _latin(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), f"[^{LATIN} \\t-\\r]+", "")


def tokens(c: Column | str, profile: str = "letters") -> Column:
    """Non-empty tokens of the matching form; null text has none."""
    if profile == "letters":  # blanks needn't be squeezed to be split at: half the time
        return F.array_remove(F.split(F.coalesce(_latin(c), F.lit("")), _BLANK), "")
    return F.filter(F.split(F.coalesce(PROFILES[profile](c), F.lit("")), " "), lambda t: t != "")


def grams(words: Column, n: int) -> Column:
    """All runs of n neighbours, joined by a space; none if there are fewer words."""
    span = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(span, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def verse_code(surah: Column | str, ayah: Column | str) -> Column:
    return F.format_string("%03d%03d", _col(surah).cast("int"), _col(ayah).cast("int"))


def arabic_digits(c: Column | str) -> Column:
    return F.translate(_col(c).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")


def first_non_empty(*cols: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_col(c), F.lit("")) for c in cols[:-1]), _col(cols[-1]))


def matches_query(query: str, text_col: str, id_col: str) -> Column:
    """Search box: a case-insensitive substring, or the exact identifier."""
    q = query.strip().lower()
    return F.lower(F.col(text_col)).contains(q) | (F.col(id_col).cast("string") == q)
