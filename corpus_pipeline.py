"""The corpus pipeline: documents to a sharded, mixed, decontaminated, deduplicated corpus.

Each stage works on all rows that the one before kept and returns the columns of ``documents``; the last returns id, language,
source and length of each row of the mixture with the tier and version of its shard, not the shard's name or the row in it. Stages: quality rules (rejected documents go), N-gram Jaccard join (five words, 0.8; the smallest id of each
group stays), benchmark decontamination (contaminated documents go), mixing (rows repeated or left out to meet the sources' targets),
sharding (size-tiered shards with a versioned manifest).

Defined cases: null and empty texts fail the quality stage (no words), so they go; rows without an id are kept or dropped by their text as others
are; repeated rows are near-duplicates of one another, one stays; an empty table gives an empty result; extra columns of documents,
whatever their names, are passed through up to the last stage. Each stage's table is deleted once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from attestry.llm._spark import load, release, shared_dir, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, k=5, p=80, q=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = sharding.shard(docs, f"{shared_dir(spark)}/attestry-corpus-{uuid.uuid4().hex}")
    return store.places("doc_id", "lang", "source", "n_chars").select("doc_id", "lang", "source", "n_chars", F.col("tier"), F.col("version"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
        if before is not None:
            release(spark, before)  # the step has written all it takes from there
        before = docs
    return docs


#: Jaccard components can't be said in SQL at any size; tests hold run() against a brute-force version.
ORACLE_SQL = None
