"""Source divergence audit: how the sources of a language differ in the terms they use.

Plain relational. Matches of the term pattern are exploded and counted by (lang, source, term); each language's groups are crossed with its kept
vocabulary, so that terms a group never uses are rows with count 0; a self-join on the term sums, for each two groups of a language, how far
one departs from the other; a window ranks.

Matches are cut out, and those of some megabytes of text counted, in Arrow batches; what those counts add up to is dealt out once by (lang, term),
and which terms are kept is known in the task that has a term's counts. Kept terms and groups are numbers in the joins that follow.

All arithmetic is on integers: with N the group's count over the V kept terms, p = 1 + floor(scale * (count + 1) / (N + V)) and
f = floor((p - q)^2 / q). Sums are exact up to a long.

Defined cases: null text, lang and source are empty strings; a row without terms still makes its (lang, source) a group; a language
without a kept term has pairs of value 0 and no terms; repeated rows are documents of their own; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._spark import release, stage
from ._words import Words, slices

#: A term is a match of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``: letters and all beyond ASCII.
BETWEEN = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])


def _share(count: Column, n: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / n); on decimals where the product leaves a long."""

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    small = div((count + 1) * F.lit(scale).cast("bigint"), n)
    large = div((count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(12,0)"), n.cast("decimal(20,0)"))
    return 1 + F.when(count < (1 << 62) // scale, small).otherwise(large)


def _departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sum of each column for each; without columns, how many there are."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not columns:
        return keys[start], np.diff(np.append(start, len(keys)))
    return keys[start], *(np.add.reduceat(c[order], start) if len(start) else c for c in columns)


def _counted(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, n, docs) of each ``limit`` bytes of text."""
    for batch in batches:
        for a, b, data, offsets in slices(batch, "text", limit):
            words = Words(data, offsets, BETWEEN, lower=True)
            if not len(words.starts):
                continue
            length = words.ends - words.starts
            ends = np.append(0, np.cumsum(length))
            letters = words.bytes[~BETWEEN[words.bytes]]
            terms = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
            distinct = np.int64(len(terms.dictionary))
            per_doc, n = _summed(words.doc_of_word() * distinct + terms.indices.to_numpy())
            lang, source = (batch.column(c).slice(a, b - a).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            keys, n, docs = _summed(group[per_doc // distinct] * distinct + per_doc % distinct, n, np.ones(len(n), np.int64))
            group, term = keys // distinct, keys % distinct
            columns = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), terms.dictionary.take(pa.array(term)), pa.array(n), pa.array(docs)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in columns])


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, slice_bytes: int = 4_000_000) -> DataFrame:
    """(lang, term, t, lang_n, source, n) of terms in at least ``least_docs`` documents of their language; t numbers (lang, term)."""
    rows = _named(docs, (lang, "lang"), (source, "source"), (text, "text"))
    parts = rows.mapInArrow(lambda b: _counted(b, slice_bytes), "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # sorted by a hash first, as most terms of a task have the same language
    counts = counts.withColumns({"h": F.xxhash64("lang", "term"), "id": F.monotonically_increasing_id()})
    same = W.partitionBy("h", "lang", "term")
    kept = counts.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("docs").over(same), "t": F.min("id").over(same)})
    return kept.filter(F.col("lang_docs") >= least_docs).select("lang", "term", "t", "lang_n", "source", "n")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, scale: int = 10**9, top: int = 200, salts: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: item is each other source of the language, value f summed over its kept terms.
    Part ``term``: item is each kept term that the group uses more than the language does, value its f, the ``top`` largest.

    ``salts``: a language's groups are copied to as many keys, over which its vocabulary is spread, as one language may have most terms."""
    spark = docs.sparkSession
    kept = stage(kept_terms(docs, text, lang, source, least_docs), "kept")
    groups = _named(docs, (lang, "lang"), (source, "source")).distinct().withColumn("g", F.monotonically_increasing_id())
    groups = stage(groups, "groups")
    vocabulary = kept.groupBy("t").agg(F.min("lang").alias("lang"), F.min("lang_n").alias("lang_n"))
    of_lang = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(of_lang, "lang").join(totals, ["lang", "source"], "left").withColumn("all", F.coalesce("total", F.lit(0)) + F.col("v"))
    sized = stage(sized.select("lang", "source", "g", "all", (F.col("lang_total") + F.col("v")).alias("lang_all")), "sized")

    said = kept.join(sized, ["lang", "source"])
    p = _share(F.col("n"), F.col("all"), scale)
    q = _share(F.col("lang_n"), F.col("lang_all"), scale)
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = said.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", _departure(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    spread = sized.select("lang", "g", "all", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dense = vocabulary.select("t", "lang", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int").alias("salt")).join(spread, ["lang", "salt"])
    dense = dense.select("t", "g", F.lit(0).cast("bigint").alias("n"), "all").unionByName(said.select("t", "g", "n", "all"))
    cells = dense.repartition("t").groupBy("t", "g").agg(F.sum("n").alias("n"), F.max("all").alias("all")).select("t", "g", p.alias("p"))
    other = cells.select("t", F.col("g").alias("h"), F.col("p").alias("q"))
    sums = cells.join(other, "t").filter("g <> h").groupBy("g", "h").agg(F.sum(_departure(F.col("p"), F.col("q"))).alias("value"))
    sums = stage(sums, "sums")
    pairs = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h")), "lang").filter("g <> h").join(sums, ["g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    out = stage(pairs.unionByName(terms), "divergence")
    release(spark, kept, groups, sized, sums)
    return out
