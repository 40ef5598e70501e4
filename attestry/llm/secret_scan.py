"""Secret scans with one combined automaton.

All rules are compiled together: subset construction and minimisation give one transition array, and one pass over the bytes of
many pieces of text at once tells which rules match in which piece. Pieces are cut at bytes after which no match goes on (the
automaton says which), so no match is cut. Only pieces with a match are read again, once backwards by the rule's reversed automaton for the
places where a match begins, then forwards from these for spans: time follows the length of a text whatever it holds.

Spans are leftmost, longest and do not overlap within a rule; a rule's ``least`` then drops short ones. Places are code points.

Defined cases: null reads as empty; repeated rows are scanned alike; long texts are scanned whole, line noise too; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._automata import Automaton, scan_pieces
from ._words import slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: least length of the value, which follows ``head``, or of the whole match
    least: int = 1
    head: str = ""
    #: what every match that is long enough holds, with few counted states; stands for ``pattern`` in the combined automaton
    core: str = ""


_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _HEAD + r"[A-Za-z0-9+/_.=\-]+", 12, _HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, core=r"[0-9a-f]{16}"),
)
MORE = (
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9_.=\-]{20,}", core=r"(?i:bearer)\x20+[A-Za-z0-9_.=\-]"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36}", core=r"gh[opsu]_[A-Za-z0-9]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", core=r"\.eyJ[A-Za-z0-9_\-]"),
    Rule("pem", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----", core=r"PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\-]{10,}", core=r"xox[abprs]-[A-Za-z0-9\-]"),
    Rule("url", r"[a-z]+://[A-Za-z0-9._\-]+:[A-Za-z0-9._%+~\-]{3,}@[A-Za-z0-9.\-]+", core=r"[A-Za-z0-9._\-]:[A-Za-z0-9._%+~\-]+@[A-Za-z0-9.\-]"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([r.core or r.pattern for r in rules], search=True)
        self.one = [Automaton([r.pattern], search=False) for r in rules]
        self.head = [Automaton([r.head], search=False) if r.head else None for r in rules]
        # no match of any rule holds these bytes
        self.cuts = np.all([a.kills() for a in self.one], axis=0)
        self.back = [Automaton([r.pattern], search=True, reverse=True) for r in rules]

    def spans(self, data: bytes, begin: int, end: int, rule: int) -> list[tuple[int, int]]:
        """Byte spans of one rule in a piece. Only places from which a match is known to follow are tried, so noise is read once."""
        out, at, dfa, head = [], begin, self.one[rule], self.head[rule]
        for start in self.back[rule].begins(data, begin, end):
            if start < at:
                continue
            at = dfa.longest(data, start, end)
            # the value begins behind the longest head that leaves at least one byte of value
            value = head.longest(data, start, at - 1) if head else start
            if at - value >= self.rules[rule].least:
                out.append((start, at))
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """For each text: (start, end, rule) in code points, sorted."""
        base, top = int(offsets[0]), int(offsets[-1])
        data, offsets = data[base:top], offsets - base
        edge = np.zeros(len(data) + 1, bool)
        edge[1:][self.cuts[data]] = True
        edge[offsets] = True
        edge = np.flatnonzero(edge)
        starts, ends = edge[:-1], edge[1:]
        found = scan_pieces(self.all, data, edge) if len(edge) > 1 else np.zeros(0, np.int64)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        raw = data.tobytes() if found.any() else b""
        for p in np.flatnonzero(found).tolist():
            doc = int(np.searchsorted(offsets, starts[p], side="right")) - 1
            for rule in range(len(self.rules)):
                if found[p] >> rule & 1:
                    hits.setdefault(doc, []).extend((a, b, rule) for a, b in self.spans(raw, int(starts[p]), int(ends[p]), rule))
        for doc in range(len(offsets) - 1):
            if doc not in hits:
                yield []
                continue
            begin = int(offsets[doc])
            count = np.concatenate([[0], np.cumsum((data[begin : int(offsets[doc + 1])] & 0xC0) != 0x80)])
            yield sorted((int(count[a - begin]), int(count[b - begin]), rule) for a, b, rule in hits[doc])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per row of ``docs``: key and spans (kind, start, end), by start and then by the rules' order."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    scanner = Scanner(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in sorted(found, key=lambda x: (x[0], x[2]))]
                for _, _, data, offsets in slices(batch, "text")
                for found in scanner.scan(data, offsets)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, SPANS)], ["key", "spans"])

    out = T.StructType([rows.schema["key"], *T.StructType.fromDDL("spans array<struct<kind:string,start:int,end:int>>")])
    return rows.mapInArrow(scan, out).withColumnRenamed("key", key)
