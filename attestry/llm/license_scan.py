"""Fuzzy search for short licence notices.

Texts are lower-cased (A-Z), cut into words of digits, letters and non-ASCII characters, and the words joined by one space. A
notice that may be off by ``e`` edits is split into ``e + 1`` pieces: whatever the edits, one piece stands unchanged (pigeonhole).
Exact searches for all pieces give the candidate places; around each, a bit-parallel search verifies
the notice with at most ``e`` edits, and the regex library's bounded-error matching gives its span. Phrases of the base set are places of exact words.

Defined cases: null reads as empty, no words and no spans; overlapping places all count; repeated rows are scanned alike; long
texts are scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices as they stand in files, lower case, words only: (label, notice).
NOTICES = (
    ("agpl-3.0", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("artistic-2.0", "the artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsl-1.0", "boost software license version 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "creative commons zero v1 0 universal"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("proprietary", "all rights reserved no part of this"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
)

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("words", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64())]))


def edits_allowed(notice: str, rate: float) -> int:
    """Edits grow with a notice's length."""
    return int(len(notice) * rate)


class Scanner:
    def __init__(self, base: dict[str, str], notices: tuple[tuple[str, str], ...], rate: float):
        self.base = [(phrase.encode(), label, regex.compile(rb"(?<![^ ])" + phrase.encode() + rb"(?![^ ])")) for phrase, label in base.items()]
        self.last_words = sorted({phrase.encode().split()[-1] for phrase in base})
        self.notices = []
        where: dict[bytes, list[tuple[int, int]]] = {}
        for i, (label, notice) in enumerate(notices):
            e = edits_allowed(notice, rate)
            patterns = [regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={n}}}") for n in range(e + 1)]
            self.notices.append((label, notice, e, patterns, _bits(notice)))
            cuts = [len(notice) * j // (e + 1) for j in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(notice[a:b].encode(), []).append((i, a))
        self.pieces = list(where.items())

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[dict]]:
        """Words, base places as (first word, label), spans of notices."""
        words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
        joined = b" ".join(words)
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        places = []
        if any(w in joined for w in self.last_words):
            for phrase, label, pattern in self.base:
                if phrase in joined:
                    places += [(bisect_right(starts, m.start()) - 1, label) for m in pattern.finditer(joined, overlapped=True)]
        return len(words), places, _best(self.near(joined, starts))

    def near(self, joined: bytes, starts: list[int]) -> list[dict]:
        """Spans of all notices in words joined by one space that begin at ``starts``."""
        near: dict[int, list[int]] = {}
        for piece, at in self.pieces:
            found = joined.find(piece)
            while found >= 0:
                for i, offset in at:
                    near.setdefault(i, []).append(found - offset)
                found = joined.find(piece, found + 1)
        # one byte a character, so that places are places of bytes; notices are ASCII
        seen = joined.decode("latin-1") if near else ""
        spans = []
        for i, begins in near.items():
            label, notice, e, patterns, bits = self.notices[i]
            found = set()
            for lo, hi in _windows(sorted(begins), len(notice), e, len(seen)):
                exact = seen.find(notice, lo, hi)
                if exact >= 0:
                    found.add((exact, exact + len(notice), 0))
                elif (least := _least_edits(bits, len(notice), seen[lo:hi])) <= e and (m := patterns[least].search(seen, lo, hi)):
                    found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
            for a, b, edits in _places(found, len(notice)):
                # edits at the borders may take in the space beside a notice
                a += len(seen[a:b]) - len(seen[a:b].lstrip())
                spans.append({"label": label, "first_word": bisect_right(starts, a) - 1, "words": len(seen[a:b].split()), "edits": edits, "similarity": 1 - edits / len(notice)})
        return spans


def _bits(notice: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(notice):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _least_edits(bits: dict[str, int], length: int, text: str) -> int:
    """Least edits from the notice to any part of the text: Myers' bit-parallel search, whose cost doesn't grow with the edits allowed."""
    every, last = (1 << length) - 1, 1 << (length - 1)
    up, down, score, least = every, 0, length, length
    for c in text:
        eq = bits.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | every & ~(h | up), up & h
        if more & last:
            score += 1
        elif less & last:
            score -= 1
            least = min(least, score)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | every & ~(v | more), more & v
    return least


def _best(spans: list[dict]) -> list[dict]:
    """Without spans of which a more similar one covers more than half (notices that differ by a version or a clause), in text order.
    Notices that follow each other may share words at the border, where edits reach into the next one."""
    most = max((s["words"] for s in spans), default=0) + 1
    kept: dict[int, list[dict]] = defaultdict(list)  # by stretches of so many words: what overlaps begins in the same or the next one
    for s in sorted(spans, key=lambda s: -s["similarity"]):
        at = s["first_word"] // most
        beside = (k for i in (at - 1, at, at + 1) if i in kept for k in kept[i])
        over = (k for k in beside if 2 * (min(k["first_word"] + k["words"], s["first_word"] + s["words"]) - max(k["first_word"], s["first_word"])) > min(k["words"], s["words"]))
        if all(k["similarity"] <= s["similarity"] for k in over):
            kept[at].append(s)
    return sorted((s for some in kept.values() for s in some), key=lambda s: (s["first_word"], s["label"], s["edits"]))


def _windows(begins: list[int], length: int, e: int, n: int) -> Iterator[tuple[int, int]]:
    """Windows in which a notice may stand, given where it would begin without shifts. Begins at most ``e`` apart share a window, as they come
    from one place; a window is so short that no second place fits in (below an edit in five characters)."""
    i = 0
    while i < len(begins):
        first = last = begins[i]
        while i < len(begins) and begins[i] <= first + e:
            last = begins[i]
            i += 1
        yield max(0, first - e), min(n, last + length + e)


def _places(found: set[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Spans of one notice, the one with the fewest edits of those that share more than half of it."""
    kept: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by stretches that no span is longer than
    for a, b, edits in sorted(found, key=lambda f: (f[2], f)):
        at = a // (2 * length)
        if all(2 * (min(b, d) - max(a, c)) <= length for i in (at - 1, at, at + 1) if i in kept for c, d, _ in kept[i]):
            kept[at].append((a, b, edits))
    return sorted(s for some in kept.values() for s in some)


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", base: dict[str, str] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, edit_rate: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: key, n_words, base (array of first_word and label), spans (notices with at most ``edit_rate``
    edits a character)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    place = pa.list_(pa.struct([("first_word", pa.int32()), ("label", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, edit_rate)
        for batch in batches:
            got = [scanner.scan(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(np.array([g[0] for g in got], np.int64)),
                    pa.array([[{"first_word": w, "label": x} for w, x in sorted(g[1])] for g in got], place),
                    pa.array([g[2] for g in got], SPANS),
                ],
                ["key", "n_words", "base", "spans"],
            )

    more = "n_words bigint, base array<struct<first_word:int,label:string>>, spans array<struct<label:string,first_word:int,words:int,edits:int,similarity:double>>"
    out = T.StructType([rows.schema["key"], *T.StructType.fromDDL(more)])
    return rows.mapInArrow(scan, out).withColumnRenamed("key", key)
