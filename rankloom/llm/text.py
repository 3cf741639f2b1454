"""Text normalisation shared by the corpus problems."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

# Fixed value: the CJK blocks that are read character by character.
CJK = "㐀-䶿一-鿿豈-﫿"

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_HIDDEN = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
_MARKS = re.compile("[̀-ͯ]")
_TOKEN = re.compile(f"[{CJK}]|[^\\W_{CJK}]+")
_HAS_CJK = re.compile(f"[{CJK}]")
_PLAIN = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
# Each begins with the character that ends a sentence or begins a label, so that all others are passed over quickly.
_SENTENCE_END = re.compile(r"[\s。！？](?:(?<=[\r\n。！？])|(?<=[.!?]\s)|(?<=[.!?]['\"”»)]\s))")
_DOI = re.compile(r"10\.\d{4,9}/[a-z0-9][a-z0-9._\-/:()]*")
_VERSION = re.compile(r"[./]v\d{1,3}$")
_LEAD_IN = {"abstract", "summary", "zusammenfassung", "resume", "resumen", "摘要"}


def clean(s: str | None) -> str:
    """Markup, entities and invisible characters removed; compatibility forms unified; case kept."""
    if not s:
        return ""
    for _ in range(2):
        if "&" in s:
            s = html.unescape(s)
    if "<" in s:
        s = _TAG.sub(" ", s)
    if not s.isascii():
        s = _HIDDEN.sub("", s)
        if not unicodedata.is_normalized("NFKC", s):
            s = unicodedata.normalize("NFKC", s)
    return s


def fold(s: str) -> str:
    """Case and diacritics removed, after :func:`clean`."""
    s = s.casefold()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
        s = unicodedata.normalize("NFC", s)
    return s


def words(folded: str) -> list[str]:
    """Words of folded text; a run of CJK characters gives its overlapping pairs, a single one itself."""
    if folded.isascii():
        return folded.translate(_PLAIN).split()
    raw = _TOKEN.findall(folded)
    if not _HAS_CJK.search(folded):
        return raw
    out: list[str] = []
    before = False  # whether the character before was CJK
    for i, t in enumerate(raw):
        here = len(t) == 1 and bool(_HAS_CJK.match(t))
        if here:
            after = i + 1 < len(raw) and len(raw[i + 1]) == 1 and bool(_HAS_CJK.match(raw[i + 1]))
            if after:
                out.append(t + raw[i + 1])
            elif not before:
                out.append(t)
        else:
            out.append(t)
        before = here
    return out


def sentences(s: str | None) -> list[list[str]]:
    """Words of each sentence of a text; empty sentences and a lead-in such as "Abstract:" are left out."""
    text = clean(s)
    if text.isascii():
        out = [w for part in _SENTENCE_END.split(text.casefold()) if (w := words(part))]
    else:
        out = [w for part in _SENTENCE_END.split(text) if (w := words(fold(part)))]
    if out and out[0][0] in _LEAD_IN:
        out[0] = out[0][1:]
    return [w for w in out if w]


def dois(folded: str) -> list[str]:
    """DOIs in folded text, each without resolver, trailing punctuation and version suffix."""
    if "10." not in folded:
        return []
    return [d for m in _DOI.findall(folded.replace("%2f", "/")) if (d := bare_doi(m))]


def bare_doi(found: str) -> str:
    """A DOI that identifies: without punctuation at its end and version; '' if its suffix has no digit."""
    d = _VERSION.sub("", found.rstrip(".,;:()/-_"))
    suffix = d.partition("/")[2]
    return d if any(c.isdigit() for c in suffix) else ""


def strip_dois(folded: str) -> str:
    """Folded text in which each DOI, with its label and resolver, is a line break."""
    if "10." not in folded:
        return folded
    return _LABELLED.sub("\n", folded.replace("%2f", "/"))


_LABELLED = re.compile(rf"https?://[^\s/]+/{_DOI.pattern}|doi(?<=\bdoi)\s*:?\s*{_DOI.pattern}|{_DOI.pattern}")


@lru_cache(maxsize=400_000)
def token_hash(t: str) -> int:
    return xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(token_hash, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values (shifts and odd multipliers)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=400_000)
def alike(a: str, b: str) -> bool:
    """Whether two words are the same but for a misspelling.

    One edit from four characters on, two from nine; numbers and words with digits only if equal.
    """
    if a == b:
        return True
    la, lb = len(a), len(b)
    short = min(la, lb)
    if short < 4 or abs(la - lb) > 2 or not (a.isalpha() and b.isalpha()):
        return False
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[la - 1 - j] == b[lb - 1 - j]:
        j += 1
    x, y = a[i : la - j], b[i : lb - j]
    if len(x) <= 1 and len(y) <= 1 or len(x) == len(y) == 2 and x[0] == y[1] and x[1] == y[0]:
        return True
    if short < 9 or max(len(x), len(y)) > 12:
        return False
    # Each letter that the other word lacks takes an edit.
    return len(set(x).difference(y)) <= 2 and len(set(y).difference(x)) <= 2 and distance(x, y) <= 2


def distance(x: str, y: str) -> int:
    """Edit distance; swapping two neighbours counts as one edit."""
    above: list[int] = []
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        older, above = above, row
        row = [i]
        for j, d in enumerate(y, 1):
            best = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (c != d))
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]
