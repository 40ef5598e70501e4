"""The registered queries of this subpackage: production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, delta_lloyd, divergence, jaccard_join, language_id, license_scan, pii_surrogates, secret_scan, sharding, substring_dedup
from ._spark import load, shared_dir
from .mixing import mix_plan
from .quality_rules import quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = language_id.identify(docs, docs.filter(~F.coalesce(held, F.lit(False))), per_lang=400)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(load(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_distinct(F.concat("base.label", "spans.label")))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").cast("long").alias("first_word"), F.array_max("base.first_word").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10, k=5)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Windows of items found in documents, as word sequences joined by spaces.
OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iwin) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN iwin USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), span=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as word sequences joined by spaces.
OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
p AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) a
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS i FROM p) b WHERE b.doc_id = a.doc_id AND b.i = a.i) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(load(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE]

    def many(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[many(k) for k in kinds], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines AS soft_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed OR soft_failed)::DOUBLE AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS mean, var_pop(k / n) AS v FROM h),
s AS (SELECT source, (k + mean * st) / (n + st) AS rate
      FROM h, (SELECT mean, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS st FROM p))
SELECT f.doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft_failed AND rate > 0.5) AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


#: Water filling as a search for the level: the first source, in the order of size over weight, whose cap is above its share of the rest.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][1 + (r - 1) % 3] AS weight FROM s),
l AS (SELECT a.source, a.source_size, a.cap, a.weight, a.cap / a.weight AS ratio,
             (SELECT 1.5 * sum(source_size) FROM w) AS total,
             row_number() OVER (ORDER BY a.cap / a.weight, a.source NULLS LAST) AS place, coalesce(sum(a.cap) OVER f, 0) AS done, (SELECT sum(weight) FROM w) - coalesce(sum(a.weight) OVER f, 0) AS left_weight
      FROM w a WINDOW f AS (ORDER BY a.cap / a.weight, a.source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((total - done) / left_weight, place) FILTER (ratio > (total - done) / left_weight) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target FROM w, v),
q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM q)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""

def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(load(spark, sf_dir, "documents"), k=4, p=85, q=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stand-in for the invented test tables; real runs set their own
    secret = spark.conf.get("spark.attestry.pii.secret", "stand-in for test tables")
    done = pii_surrogates.replace_pii(load(spark, sf_dir, "documents"), secret)
    return done.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard(load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/attestry-shards-{uuid.uuid4().hex}", arrivals=2)
    return store.places("doc_id")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, _ = delta_lloyd.cluster(load(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256)
    return delta_lloyd.digest(rows, centroids).select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds written out: c0, a1, c1, a2, ... with components as rows."""
    out = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k}))"""]
    for i in range(1, rounds + 2):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i - 1} m) v GROUP BY vec_id)""")
        if i <= rounds:
            out.append(f"""c{i} AS MATERIALIZED (SELECT c, coalesce(n.x, m.x) AS x FROM c{i - 1} m LEFT JOIN (SELECT c, list(s ORDER BY j) AS x
      FROM (SELECT c, j, ((sum(e) - (sum(e) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS s FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) n USING (c))""")
    last = rounds + 1
    return f"""WITH {", ".join(out)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{last} JOIN c{rounds} m USING (c)"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    back = chat_format.read_back(chat_format.windows(rows.unionByName(more), budget=1024, history=128, block=256))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.withColumns({"said": said, "loss": F.array_join("targets", "")})
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


#: The texts by themselves; the length of the windows from the prefix sums of tokens in blocks of 256 turns.
OP12_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
           SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
t AS (SELECT *, floor(turn / 256)::BIGINT AS b, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
      length('### ' || role || ': ' || replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\h') || '</turn>' || chr(10)) AS chars FROM r),
sys AS (SELECT conv_id, k AS sys_k, chars AS sys_chars FROM t WHERE n = 1 AND role = 'system'),
u AS (SELECT t.*, coalesce(sum(k) OVER (PARTITION BY conv_id, b ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(k) OVER (PARTITION BY conv_id, b) AS total
      FROM t LEFT JOIN sys USING (conv_id) WHERE NOT (n = 1 AND sys_k IS NOT NULL)),
c AS (SELECT u.*, coalesce(sys_chars, 0) AS sys_chars, greatest(896 - coalesce(sys_k, 0), 256) AS room FROM u LEFT JOIN sys USING (conv_id)),
p AS (SELECT *, floor(room * 3 / 4) AS cell, floor(s / floor(room * 3 / 4)) AS w FROM c),
a AS (SELECT *, s + k > (w + 1) * cell AND k > room - cell AS alone FROM p),
win AS (SELECT conv_id, b, w, alone, min(s) AS start, any_value(sys_chars) AS sys_chars, sum(chars) AS own FROM a GROUP BY ALL),
back AS (SELECT win.conv_id, win.b, win.w, win.alone, sum(chars) AS past FROM win JOIN a ON a.conv_id = win.conv_id
         AND (a.b = win.b AND a.s < win.start AND a.s >= win.start - 128 OR a.b = win.b - 1 AND win.start = 0 AND a.s >= a.total - 128) GROUP BY ALL),
f AS (SELECT conv_id, sum(own + sys_chars + coalesce(past, 0)) AS formatted_chars FROM win LEFT JOIN back USING (conv_id, b, w, alone) GROUP BY conv_id
      UNION ALL SELECT conv_id, sys_chars FROM sys WHERE conv_id NOT IN (SELECT conv_id FROM a)),
x AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said, coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant' ), '') AS loss FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM x JOIN f USING (conv_id)
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(load(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
once AS (SELECT lang, unnest(list_distinct(w)) AS term FROM d),
kept AS (SELECT lang, term FROM once GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_decontamination": op3_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_chat_format": op12_chat_format,
    "op13_divergence": op13_divergence,
}
ORACLES: dict[str, str] = {"op3_decontamination": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op11_delta_lloyd": _op11_sql(), "op12_chat_format": OP12_SQL, "op13_divergence": OP13_SQL}
