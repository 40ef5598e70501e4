"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. Every ``k``-word run is hashed; of each
``window - k + 1`` consecutive runs only the smallest hash is kept, so a shared span of ``window`` words keeps the same fingerprint
on both sides and can't be missed. Fingerprints of documents and benchmark items are joined, and each hit is extended to the
windows around it, word by word hash. Items shorter than the window have one window, the whole item, and are fingerprinted by it.

The join is a lookup in a broadcast index while the benchmark has at most ``max_windows`` windows (counted first); beyond that it
is a shuffle join of fingerprints, then of the texts of candidate pairs.

Defined cases: null or empty texts have no words and no hits; an item with null id is listed as ``null``; items with equal ids
count once; repeated documents each get their row; an empty benchmark hits nothing; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import NON_ALNUM, U64, Words, mix, runs, slices, window_min_places

HITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _fingerprint_places(words: np.ndarray, doc_of: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept runs of texts that lie behind one another."""
    h = runs(words, k)
    n = len(h)
    w = window - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    # windows over two texts are dropped after the minimum is taken
    best, place = h[: n - w + 1].copy(), np.arange(n - w + 1)
    for j in range(1, w):
        other = h[j : j + n - w + 1]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + j
    whole = doc_of[: n - w + 1] == doc_of[window - 1 : window - 1 + n - w + 1]
    place = place[whole]
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    return place, h[place]


class Index:
    """Windows of benchmark items: sorted hashes with the items that have them, for the full window and each shorter length."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, k: int):
        self.window, self.k, self.ids = window, k, ids
        batch = pa.array([t or "" for t in texts], pa.large_string())
        tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = []
        for at, to, data, offsets in slices(pa.RecordBatch.from_arrays([batch], ["t"]), "t"):
            words = Words(data, offsets, NON_ALNUM, True)
            hashes, counts = words.hashes(), np.diff(words.doc)
            full = runs(hashes, window)
            doc_of = words.doc_of_word()
            inside = doc_of[: len(full)] == doc_of[window - 1 : window - 1 + len(full)]
            tables.setdefault(window, []).append((full[inside], at + doc_of[: len(full)][inside]))
            prints.append(_fingerprint_places(hashes, doc_of, window, k)[1])
            for i in np.flatnonzero((counts > 0) & (counts < window)):
                tables.setdefault(int(counts[i]), []).append((runs(hashes[words.doc[i] : words.doc[i + 1]], int(counts[i])), np.array([at + i])))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, parts in tables.items():
            h, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((item, h))
            h, item = h[order], item[order]
            keys, first = np.unique(h, return_index=True)
            self.tables[length] = keys, np.append(first, len(h)), item

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hits as (text, first word, words, item); first word counts from the first of all texts."""
        hashes = words.hashes()
        doc_of = words.doc_of_word()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length, (keys, first, items) in self.tables.items():
            if not len(keys) or len(hashes) < length:
                continue
            if length == self.window:
                place, prints = _fingerprint_places(hashes, doc_of, self.window, self.k)
                place = place[_among(prints, self.prints)]
                start = np.unique((place[:, None] - np.arange(self.window - self.k + 1)).ravel())
                start = start[(start >= 0) & (start + length <= len(hashes))]
                h = mix(_polynomial(hashes, start, length))
            else:
                start, h = np.arange(len(hashes) - length + 1), runs(hashes, length)
            ok = _among(h, keys) & (doc_of[start] == doc_of[start + length - 1])
            start, at = start[ok], np.searchsorted(keys, h[ok])
            many = first[at + 1] - first[at]
            item = items[np.repeat(first[at], many) + _ramps(many)]
            out.append((np.repeat(start, many), np.full(len(item), length), item))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        start, length, item = (np.concatenate(x) for x in zip(*out, strict=True))
        return doc_of[start] if len(start) else start, start, length, item


def _polynomial(words: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    from ._words import _Q

    h = words[start].copy()
    for j in range(1, length):
        h *= _Q
        h += words[start + j]
    return h


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def _ramps(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of sorted or unsorted half-open spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > end[:-1]
    return start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)]


def _found(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], list[list[str]]]]:
    """For each row of a batch: words, spans, items."""
    for at, to, data, offsets in slices(batch, "text"):
        words = Words(data, offsets, NON_ALNUM, True)
        doc, start, length, item = index.scan(words)
        order = np.argsort(doc, kind="stable")
        doc, start, length, item = doc[order], start[order], length[order], item[order]
        cut = np.searchsorted(doc, np.arange(to - at + 1))
        for i in range(to - at):
            a, b = cut[i], cut[i + 1]
            n = int(words.doc[i + 1] - words.doc[i])
            if a == b:
                yield n, 0, [], []
                continue
            s, e = union(start[a:b] - words.doc[i], start[a:b] - words.doc[i] + length[a:b])
            yield n, int((e - s).sum()), list(zip(s.tolist(), e.tolist(), strict=True)), sorted({index.ids[j] for j in np.unique(item[a:b])})


def _rows(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_found(batch, index))
        arrays = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
        arrays += [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([[{"start": s, "end": e} for s, e in r[2]] for r in rows], SPAN),
            pa.array([r[3] for r in rows], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(arrays, [n for n in batch.schema.names if n != "text"] + ["n_words", "n_hit", "hits", "items"])


def _fits(benchmark: DataFrame, max_windows: int) -> bool:
    """Whether the benchmark's index is small enough to be broadcast; an item has fewer windows than characters."""
    return benchmark.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= 4 * max_windows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, text: str = "text", key: str = "doc_id", item: str = "item_id", max_windows: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit (words inside a shared window), hits (maximal spans of word places) and items
    (distinct ids as strings, sorted)."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col("text"))
    if _fits(benchmark, max_windows):
        got = items.collect()
        index = Index([r["item"] for r in got], [r["text"] for r in got], window, k)
        out = T.StructType([rows.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", HITS), T.StructField("items", T.ArrayType(T.StringType()))])
        found = rows.mapInArrow(lambda batches: _rows(batches, index), out)
    else:
        found = _by_join(rows, items, window, k)
    return found.withColumnRenamed("key", key)


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, k: int, lengths: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each row: kept runs, and whole runs of the shorter lengths (None: of the row's own length, if short)."""
    for batch in batches:
        for at, to, data, offsets in slices(batch, "text"):
            words = Words(data, offsets, NON_ALNUM, True)
            hashes, doc_of, counts = words.hashes(), words.doc_of_word(), np.diff(words.doc)
            place, prints = _fingerprint_places(hashes, doc_of, window, k)
            row, value = [doc_of[place]], [prints]
            for length in range(1, window) if lengths is None else lengths:
                h = runs(hashes, length)
                start = np.arange(len(h))
                ok = doc_of[: len(h)] == doc_of[length - 1 : length - 1 + len(h)]
                if lengths is None:
                    ok &= counts[doc_of[: len(h)]] == length
                row.append(doc_of[start[ok]])
                value.append(mix(h[ok] + U64(length)))
            row, value = np.concatenate(row), np.concatenate(value).view(np.int64)
            take = pa.array(at + row)
            arrays = [c.take(take) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(value)], [n for n in batch.schema.names if n != "text"] + ["fp"])


def _by_join(rows: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """The same rows with nothing broadcast: fingerprints are joined, then the texts of the pairs that share one."""
    counts = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    lengths = sorted(r[0] for r in items.select(counts.alias("n")).filter(f"n > 0 AND n < {window}").distinct().collect())
    rows = rows.withColumn("content", F.xxhash64("text"))
    schema = rows.select("key", "content").schema.add("fp", T.LongType())
    of_docs = rows.mapInArrow(lambda b: _fingerprints(b, window, k, lengths), schema).distinct()
    of_items = items.mapInArrow(lambda b: _fingerprints(b, window, k, None), T.StructType([items.schema["item"], T.StructField("fp", T.LongType())])).distinct()
    pairs = of_docs.join(of_items, "fp").select("key", "content", "item").distinct()
    texts = items.select(F.col("item"), F.col("text").alias("item_text"))
    named = pairs.select(F.col("key").alias("_k"), F.col("content").alias("_c"), F.col("item").alias("_i"))
    once = rows.dropDuplicates(["key", "content"])
    pairs = named.join(texts, F.col("_i") == F.col("item")).join(once, F.col("_k").eqNullSafe(F.col("key")) & F.col("_c").eqNullSafe(F.col("content"))).select("key", "content", "text", "item", "item_text")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_of = lru_cache(256)(lambda name, content: Index([name], [content], window, k))  # an item is indexed once in a task, not for each pair
        for batch in batches:
            spans = []
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                index = index_of(one.column(3)[0].as_py(), one.column(4)[0].as_py())
                spans += [[{"start": s, "end": e} for s, e in r[2]] for r in _found(one.select(["key", "text"]), index)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(spans, SPAN)], ["key", "content", "item", "spans"])

    out = T.StructType([*pairs.select("key", "content", "item").schema.fields, T.StructField("spans", HITS)])
    per = pairs.mapInArrow(hits, out).filter(F.size("spans") > 0).groupBy(F.col("key").alias("_k"), F.col("content").alias("_c"))
    per = per.agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.collect_set("item")).alias("_items"))
    merged = F.expr(
        "aggregate(all, cast(array() AS array<struct<start:int,end:int>>), (a, x) -> if(size(a) > 0 AND x.start <= a[size(a) - 1].end, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))), concat(a, array(x))))"
    )
    joined = rows.withColumn("n_words", counts.cast("long")).join(per.withColumn("_hits", merged), F.col("key").eqNullSafe(F.col("_k")) & F.col("content").eqNullSafe(F.col("_c")), "left")
    none = F.array().cast("array<string>")
    hit = F.coalesce(F.col("_hits"), F.array().cast(HITS))
    return joined.select("key", "n_words", F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_hit"), hit.alias("hits"), F.coalesce("_items", none).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_windows: int = 2_000_000, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with the columns of ``docs``, whatever their types. With an index rows go through as they are; beyond it the
    digests of the texts are judged (equal texts once) and the rows joined to them once."""
    if _fits(benchmark, max_windows):
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("text"))
        return find_contamination(rows, benchmark, key="_row", max_windows=max_windows, **options).filter("n_hit = 0").select("_row.*")
    digest = F.sha2(F.col(f"`{text}`"), 256)
    found = find_contamination(docs.select(digest.alias("digest"), F.col(f"`{text}`").alias("text")), benchmark, key="digest", max_windows=max_windows, **options)
    hit = found.filter("n_hit > 0").select(F.col("digest").alias("_digest")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest.alias("_digest"))
    return rows.join(hit, "_digest", "left_anti").select("_row.*")
