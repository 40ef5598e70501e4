"""Host-level quality rules, in DataFrame functions only.

Every document is measured on its whole text. A few rules (``base``) fail a document by themselves. Softer rules are only
evidence: their failures are added up by host, each host's failure rate is shrunk towards the corpus with a beta prior fitted to
the hosts themselves (method of moments), and a document that fails a soft rule goes only if its host's shrunk rate is high.
So a clean document stays whatever its host is like, and an odd document of a good host stays too.

Defined cases: null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows are
judged row by row alike; an empty table gives an empty result; other columns are carried along only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import stage

#: separators of words
SEP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEP), "")


#: Words covered by a three-word window that occurs again. Windows are 64-bit hashes g. Texts without an equal pair are done at
#: once; else places of equal windows are found by membership where few differ, by sorting (window, place) pairs where many do.
REPEATED = """
if(size(words) < 3, 0L, transform(array(transform(words, w -> xxhash64(w))), h ->
  transform(array(transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))), g ->
    if(size(array_distinct(g)) = size(g), 0L,
      aggregate(
        transform(array(sort_array(g)), s -> transform(array(array_distinct(filter(s, (x, j) -> x = get(s, j - 1)))), d ->
          if(size(d) <= 64,
            filter(sequence(0, size(g) - 1), i -> array_contains(d, g[i])),
            transform(array(sort_array(transform(g, (x, i) -> struct(x AS g, i AS i)))), p ->
              sort_array(transform(filter(p, (x, j) -> x.g = get(p, j - 1).g OR x.g = get(p, j + 1).g), x -> x.i)))[0]))[0])[0],
        named_struct('c', 0L, 'e', 0), (a, i) -> named_struct('c', a.c + i + 3 - greatest(a.e, i), 'e', i + 3), a -> a.c)))[0])[0])
"""


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(t, f"[{SYMBOLS}]+", "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.withColumn("words", words_of(F.col(text))).withColumn("lines", lines)
    return cut.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length(t) - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def flags(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 20, max_dup_line_pct: int = 50) -> dict[str, Column]:
    """base_failed and soft_failed over the columns of :func:`measures`."""
    n = F.col("n_words")
    return {
        "base_failed": (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * n),
        "soft_failed": (100 * F.col("n_symbols") > max_symbol_pct * n) | (100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines")),
    }


def host_rates(ruled: DataFrame, host: str) -> DataFrame:
    """_host and _host_rate: each host's share of failing documents, shrunk towards the corpus."""
    hosts = ruled.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.count_if(F.col("base_failed") | F.col("soft_failed")).cast("double").alias("_k")
    )
    return hosts.select("_host", shrunk(hosts).alias("_host_rate"))


def shrunk(hosts: DataFrame) -> Column:
    """Posterior mean failure rate of a host (_k of _n) under a beta prior with the hosts' mean rate and spread.

    The prior's strength is m(1-m)/v - 1 for mean m and variance v of the hosts' rates, held between 1 and 1000 (1000 where all
    hosts agree)."""
    mean = hosts.select(F.sum("_k") / F.sum("_n")).scalar()
    spread = hosts.select(F.var_pop(F.col("_k") / F.col("_n"))).scalar()
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / spread - 1))).otherwise(1000.0)
    return (F.col("_k") + mean * strength) / (F.col("_n") + strength)


def judged(ruled: DataFrame, host: str, bad_host_rate: float, rates: DataFrame | None = None) -> DataFrame:
    """Adds host_rate and kept to staged rows that have the flags; hosts join null-safely, the skew of a hot host is Spark's to split.
    ``rates`` are the hosts' rates, from the rows themselves unless given."""
    out = ruled.join(host_rates(ruled, host) if rates is None else rates, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    out = out.withColumnRenamed("_host_rate", "host_rate")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("soft_failed") & (F.col("host_rate") > bad_host_rate)))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", bad_host_rate: float = 0.5, **limits) -> DataFrame:
    """One row per row of ``docs``: key, host, the measures and the verdicts."""
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{host}`"), F.col(f"`{text}`"))
    return judged(stage(measures(rows, text).withColumns(flags(**limits)), "quality"), host, bad_host_rate)


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", bad_host_rate: float = 0.5, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``. Texts are written once beside their flags, so that
    each is measured once and none is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = measures(docs.select(row, F.col(f"`{host}`").alias("_of"), F.col(f"`{text}`").alias("_text")), "_text")
    ruled = measured.withColumns(flags(**limits)).select("_row", "_of", "base_failed", "soft_failed")
    ruled = stage(ruled, "quality")
    # only soft failures ask for their host's verdict; no other text is joined
    doubtful = judged(ruled.filter("soft_failed AND NOT base_failed"), "_of", bad_host_rate, host_rates(ruled, "_of")).filter("kept")
    return ruled.filter("NOT soft_failed AND NOT base_failed").select("_row.*").unionByName(doubtful.select("_row.*"))
