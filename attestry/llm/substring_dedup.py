"""Substring deduplication: passages that stand in a document with a smaller id are removed from the later ones.

A passage is a run of at least ``span`` words. The corpus is its own reference, cut into shards that stay small:

1. Winnowed fingerprints (smallest hash of ``span - k + 1`` consecutive ``k``-word runs, so every passage keeps one) that two or more
   documents share mark candidate stretches; everything else is done with after this step.
2. The first document of each ``span``-word window within candidate stretches is the window's owner. Only pairs of owner and later document go on.
3. The stretches of an owner are a reference shard: a suffix automaton over their words is built where the documents of its pairs
   are streamed to, and matching statistics (longest suffix that occurs in the shard, word by word) give the maximal spans of at least
   ``span`` words. An owner with many documents is copied to as many tasks, one with long stretches is cut into overlapping shards.
4. Spans are joined back to the documents, and covered words removed.

Words are runs without separators (0x20, 0x09-0x0D), compared by 64-bit hashes. Windows are judged on the input, not on what is left.

Ids are integers (text that is no number is an error). Defined cases: null text has no words; rows with null id are kept whole and are no reference; rows with equal ids don't count as earlier than
one another; texts shorter than ``span`` stay; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import release, stage
from ._words import SPACE, U64, Words, runs, slices
from .decontamination import _among, _fingerprint_places, union

SHARD_WORDS = 100_000


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _once(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, so that a text that says one thing over and over sends it once."""
    order = np.lexsort((of, hashes))
    h, o = hashes[order], of[order]
    keep = np.zeros(len(h), bool)
    keep[order[np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))[: len(h)]]] = True
    return hashes[keep], of[keep]  # in the texts' order, which packs better


def _prints(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for at, _, data, offsets in slices(batch, "text"):
            words = Words(data, offsets, SPACE, False)
            doc_of = words.doc_of_word()
            place, prints = _fingerprint_places(words.hashes(), doc_of, span, k)
            prints, of = _once(prints, doc_of[place])
            yield pa.RecordBatch.from_arrays([_i64(prints), _i64(keys[at + of])], ["fp", "key"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fingerprint and key to the distinct rows of fingerprints that have two keys or more."""
    fp = first = last = None
    known = False  # the group that goes on from the batch before is shared, and its rows so far are given out
    for batch in batches:
        if not batch.num_rows:
            continue
        f, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.append(fp is None or f[0] != fp, f[1:] != f[:-1])
        other = new | np.append(key[0] != last if last is not None else True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        if not len(start) or start[0] != 0:
            start = np.append(0, start)
        size = np.diff(np.append(start, len(f)))
        head, tail = key[start], key[start + size - 1]
        goes_on = not new[0]
        if goes_on:
            head[0] = first
        shared = head != tail
        if goes_on and known:
            shared[0] = True
        out_f, out_k = [], []
        if goes_on and shared[0] and not known:
            out_f.append(f[:1])
            out_k.append(np.array([first]))
        keep = np.repeat(shared, size) & other
        out_f.append(f[keep])
        out_k.append(key[keep])
        fp, first, last, known = f[-1], head[-1], key[-1], bool(shared[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_f))], ["key", "fp"])


def _stretches(batches: Iterator[pa.RecordBatch], span: int, k: int) -> Iterator[pa.RecordBatch]:
    """Candidate stretches of each row (key, row, fps, text): first word and word hashes, cut into overlapping pieces of a shard."""
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        lists = batch.column(2)
        out_key, out_row, out_start, out_words = [], [], [], []
        for at, to, data, offsets in slices(batch, "text"):
            words = Words(data, offsets, SPACE, False)
            hashes, doc_of = words.hashes(), words.doc_of_word()
            place, prints = _fingerprint_places(hashes, doc_of, span, k)
            cut = np.searchsorted(doc_of[place], np.arange(to - at + 1))
            for i in range(to - at):
                p, h = place[cut[i] : cut[i + 1]], prints[cut[i] : cut[i + 1]]
                p = p[_among(h, np.sort(lists[at + i].values.to_numpy().view(U64)))]
                if not len(p):
                    continue
                low, high = words.doc[i], words.doc[i + 1]
                start, end = union(np.maximum(p - (span - k), low), np.minimum(p + span, high))
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    for c in range(a, max(a + 1, b - span + 1), SHARD_WORDS):
                        out_key.append(keys[at + i])
                        out_row.append(ids[at + i])
                        out_start.append(c - low)
                        out_words.append(hashes[c : min(b, c + SHARD_WORDS + span - 1)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_row, pa.int64()), pa.array(out_start, pa.int64()), pa.array(out_words, pa.binary())], ["key", "row", "start", "words"])


def _windows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: batch.num_rows + 1] // 8
        data = np.frombuffer(batch.column(2).buffers()[2], U64) if batch.column(2).buffers()[2] else np.zeros(0, U64)
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        counts = np.diff(offsets)
        for a in range(0, batch.num_rows, 256):
            z = min(batch.num_rows, a + 256)
            h = runs(data[offsets[a] : offsets[z]], span)
            of = np.repeat(np.arange(a, z), counts[a:z])
            ok = of[: len(h)] == of[span - 1 : span - 1 + len(h)]
            h, of = _once(h[ok], of[: len(h)][ok])
            yield pa.RecordBatch.from_arrays([_i64(h), _i64(keys[of]), _i64(ids[of])], ["h", "key", "row"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window hash and key to distinct pairs (owner's row, later row)."""
    h = key = row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hs, keys, ids = (batch.column(i).to_numpy() for i in range(3))
        new = np.append(h is None or hs[0] != h, hs[1:] != hs[:-1])
        place = np.maximum.accumulate(np.where(new, np.arange(len(hs)), -1))
        head_key = np.where(place >= 0, keys[place], key if key is not None else 0)
        head_row = np.where(place >= 0, ids[place], row if row is not None else 0)
        h, key, row = hs[-1], head_key[-1], head_row[-1]
        later = keys != head_key
        if later.any():
            pairs = np.unique(np.column_stack([head_row[later], ids[later]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["owner", "row"])


class SuffixAutomaton:
    """Of several word sequences: a state stands for the substrings that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:  # the sequence so far is known, but not as the longest of its state
                last = self._split(last, w, q)
                continue
            new = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def spans(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of the words that are covered by matches of at least ``least`` words."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        start = end = -1
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
                if matched >= least:
                    low = i + 1 - matched
                    if start < 0:
                        start, end = low, i + 1
                    elif low <= end:
                        start, end = min(start, low), i + 1
                    else:
                        out.append((start, end))
                        start, end = low, i + 1
        if start >= 0:
            out.append((start, end))
        return out


def _matches(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, part, row, start, words) sorted by grp and part, references (part 0) first, to spans of the documents' rows."""
    grp, automaton, whole = None, SuffixAutomaton(), set()
    for batch in batches:
        rows, starts, ends = [], [], []
        for g, part, row, start, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if g != grp:
                grp, automaton, whole = g, None, set()
            if part == 0:
                whole.add(words)
                automaton = None
                continue
            n = len(words) // 8
            if words in whole:  # the automaton would match it from end to end
                found = [(0, n)]
            else:
                if automaton is None:
                    automaton = SuffixAutomaton()
                    for w in sorted(whole):
                        automaton.add(np.frombuffer(w, np.int64).tolist())
                found = automaton.spans(np.frombuffer(words, np.int64).tolist(), span)
            for a, b in found:
                rows.append(row)
                starts.append(start + a)
                ends.append(start + b)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["row", "start", "end"])


def repeated_spans(docs: DataFrame, span: int = 13, k: int = 8, docs_per_task: int = 2000) -> DataFrame:
    """``docs`` (key bigint, row, text) to (row, start, end): word spans that stand in a row with a smaller key."""
    spark = docs.sparkSession
    prints = docs.select("key", "text").mapInArrow(lambda b: _prints(b, span, k), "fp bigint, key bigint")
    shared = prints.repartition("fp").sortWithinPartitions("fp", "key").mapInArrow(_shared, "key bigint, fp bigint")
    lists = stage(shared.groupBy(F.col("key").alias("_key")).agg(F.collect_list("fp").alias("fps")), "prints")
    release(spark)
    some = docs.join(lists, F.col("key") == F.col("_key")).select("key", "row", "fps", "text")
    stretches = stage(some.mapInArrow(lambda b: _stretches(b, span, k), "key bigint, row bigint, start bigint, words binary"), "stretches")
    release(spark, lists)

    windows = stretches.select("key", "row", "words").mapInArrow(lambda b: _windows(b, span), "h bigint, key bigint, row bigint")
    pairs = windows.repartition("h").sortWithinPartitions("h", "key", "row").mapInArrow(_owners, "owner bigint, row bigint").distinct()
    pairs = stage(pairs, "pairs")
    release(spark)
    # an owner's shards: pieces by place; its tasks: by the number of its documents
    piece = F.floor(F.col("start") / SHARD_WORDS).alias("shard")
    owners = pairs.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / docs_per_task).cast("int").alias("tasks"))
    ref = stretches.join(owners, F.col("row") == F.col("owner")).select("owner", piece, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("part"), "row", "start", "words")
    shards = stretches.join(owners.select("owner"), F.col("row") == F.col("owner"), "left_semi").groupBy(F.col("row").alias("_owner")).agg(F.collect_set(piece).alias("shards"))
    sent = pairs.join(owners, "owner").join(shards, F.col("owner") == F.col("_owner"))
    sent = sent.select("owner", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("row"), F.col("tasks")).cast("int").alias("task"), F.col("row").alias("_row"))
    query = sent.join(stretches, F.col("_row") == F.col("row")).select("owner", "shard", "task", F.lit(1).alias("part"), "row", "start", "words")
    routed = ref.unionByName(query).select(F.concat_ws(":", *[F.col(c).cast("string") for c in ("owner", "shard", "task")]).alias("grp"), "part", "row", "start", "words")
    routed = routed.repartition("grp").sortWithinPartitions("grp", "part")
    return routed.mapInArrow(lambda b: _matches(b, span), "row bigint, start bigint, end bigint").distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, spans) to (key, n_words, n_removed, spans, kept)."""
    for batch in batches:
        n_words, n_removed, kept, merged = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            found = spans.as_py() or []
            if found:
                s, e = union(np.array([x["start"] for x in found]), np.array([x["end"] for x in found]))
                merged.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                inside = np.zeros(len(words), bool)
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    inside[a:b] = True
                words = [w for w, gone in zip(words, inside.tolist(), strict=True) if not gone]
            else:
                merged.append([])
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        spans = pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = 13, k: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, spans (of removed words), kept (the other words, joined by one space)."""
    t, id_ = F.col(f"`{text}`"), F.col(f"`{key}`")
    rows = docs.select(id_.alias("key"), F.xxhash64(id_, t).alias("row"), t.alias("text"))
    spans = repeated_spans(rows.filter("key IS NOT NULL AND text IS NOT NULL").withColumn("key", F.col("key").cast("long")), span, k)
    per = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(per, F.col("row") == F.col("_row"), "left").select("key", "text", F.when(F.col("key").isNotNull(), F.col("spans")).alias("spans"))
    out = T.StructType([rows.schema["key"], *T.StructType.fromDDL("n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string")])
    return joined.mapInArrow(_cut, out).withColumnRenamed("key", key)
