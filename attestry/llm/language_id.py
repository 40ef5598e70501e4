"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

A text is the bag of its character n-grams (lower case, runs of letters with a mark at either end, everything else dropped),
hashed to ``buckets``. Its vector is the mean of their embeddings, a linear layer and softmax give the languages. Training is plain
numpy on the driver over a bounded sample of labelled rows: at most about ``per_lang`` rows of each language, chosen by a hash of
the id in two passes (counts by language, then the rows). A part of the sample is held back to fit a temperature (so that scores
are probabilities) and, for each language, the score below which a prediction is marked as rejected.

Prediction multiplies embeddings and layer once into a table of buckets by languages and broadcasts it (buckets x languages
floats, whatever the corpus), so a text costs one table row for each n-gram, whole text always.

Defined cases: null text or text without a letter is ``und`` with score 0; rows without label are never learned from; with no labelled
row at all everything is ``und``; equal scores take the first language in code point order; repeated rows and extra columns are nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import U64, mix

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ORDERS = (1, 2, 3)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts, and the number of n-grams of each text."""
    # one place before and after each text stands for a word border
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if sum(map(len, texts)) + len(texts) + 1 != len(codes):  # lower case of a character can be longer
        texts = [t.lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = np.cumsum([0] + [len(t) + 1 for t in texts])
    letter = (codes >= 128) | ((codes >= 97) & (codes <= 122))
    symbol = np.where(letter, codes, 0).astype(U64)
    out, counts = [], np.zeros(len(texts), np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(cut))
    for n in _ORDERS:
        size = len(symbol) - n
        if size <= 0:
            continue
        h = symbol[:size].copy()
        some = letter[:size].copy()
        inner = np.ones(size, bool)
        for j in range(1, n):
            h = h * U64(0x100000001B3) + symbol[j : j + size]
            some |= letter[j : j + size]
            if j < n - 1:
                inner &= letter[j : j + size]
        keep = np.flatnonzero(some & inner)
        out.append(((mix(h[keep] + U64(n << 60)) >> U64(40)).astype(np.int64) % buckets, text_of[np.minimum(keep, len(text_of) - 1)]))
    if not out:
        return np.zeros(0, np.int64), counts
    bucket, owner = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(texts))


@dataclass
class Model:
    languages: list[str]
    #: bucket by language: embeddings times the linear layer
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    #: per language: scores below it are rejected
    least: np.ndarray

    def probabilities(self, texts: list[str]) -> np.ndarray:
        bucket, counts = grams(texts, len(self.table))
        ends = np.cumsum(counts)
        run = np.zeros((len(bucket) + 1, len(self.languages)))
        np.cumsum(self.table[bucket], axis=0, out=run[1:])
        logits = (run[ends] - run[ends - counts]) / np.maximum(counts, 1)[:, None] + self.bias
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, batch: int = 64, piece: int = 600, reject: float = 0.005, seed: int = 7) -> Model:
    """Every fifth row calibrates, the others fit. Long texts are cut into pieces, all of which are learned from."""
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    fit = [(t[a : a + piece], number[y]) for i, (t, y) in enumerate(zip(texts, labels, strict=True)) if i % 5 for a in range(0, len(t), piece)]
    held = [(t[a : a + piece], number[y]) for i, (t, y) in enumerate(zip(texts, labels, strict=True)) if i % 5 == 0 for a in range(0, len(t), piece)]
    fit = fit or held
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, total = 0, max(1, epochs * -(-len(fit) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            now = [fit[i] for i in order[at : at + batch]]
            bucket, counts = grams([t for t, _ in now], buckets)
            ids, place = np.unique(bucket, return_inverse=True)
            owner = np.repeat(np.arange(len(now)), counts)
            # texts by distinct buckets: shares of each text's n-grams
            share = np.bincount(owner * len(ids) + place, minlength=len(now) * len(ids)).reshape(len(now), -1).astype(np.float32)
            share /= np.maximum(counts, 1)[:, None]
            hidden = share @ e[ids]
            logits = hidden @ w + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(now)), [y for _, y in now]] -= 1
            step = rate * (1 - steps / total)
            back = p @ w.T
            w -= step * hidden.T @ p / len(now) * 8
            b -= step * p.mean(0)
            e[ids] -= step * share.T @ back * 8
            steps += 1
    model = Model(languages, (e @ w).astype(np.float32), b, 1.0, np.zeros(len(languages)))
    return _calibrated(model, held or fit, reject)


def _calibrated(model: Model, held: list[tuple[str, int]], reject: float) -> Model:
    y = np.array([y for _, y in held])
    base = np.log(model.probabilities([t for t, _ in held]) + 1e-12)
    best = None
    for temperature in np.geomspace(0.05, 20, 49):
        z = base / temperature
        z -= z.max(1, keepdims=True)
        loss = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean()
        if best is None or loss < best[0]:
            best = loss, float(temperature)
    model.temperature = best[1]
    p = model.probabilities([t for t, _ in held])
    for i in range(len(model.languages)):
        right = np.sort(p[(y == i) & (p.argmax(1) == i), i])
        model.least[i] = right[int(len(right) * reject)] if len(right) else 1.0
    return model


def sample(docs: DataFrame, per_lang: int, text: str = "text", label: str = "lang", key: str = "doc_id", longest: int = 100_000, most_langs: int = 400) -> tuple[list[str], list[str]]:
    """Texts and labels of about ``per_lang`` rows (never above 1.5 times on average) of each language, chosen by a hash of the id and always in
    the same order. What comes to the driver is bounded: texts of more than ``longest`` characters are not learned from, and of the labels
    the ``most_langs`` most frequent ones."""
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").filter(F.length("text") <= longest)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    ticket = F.pmod(F.xxhash64(F.lit("sample"), F.coalesce("key", "text")), F.lit(1 << 30))
    chance: Column = F.lit(False)
    for lang, n in sorted(counts.items()):
        chance = chance | ((F.col("lang") == lang) & (ticket < min(1 << 30, int((1 << 30) * per_lang / n))))
    got = rows.withColumn("ticket", ticket).filter(chance).orderBy("ticket", "key", "text", "lang").limit(int(1.5 * per_lang * len(counts))).collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, rejected."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = 0
            while at < len(known):
                to, size = at, 0
                while to < len(known) and (size == 0 or size + len(texts[known[to]]) < 200_000):
                    size += len(texts[known[to]])
                    to += 1
                p = model.probabilities([texts[i] for i in known[at:to]])
                for i, row, k in zip(known[at:to], p, p.argmax(1), strict=True):
                    lang[i], score[i], rejected[i] = model.languages[k], min(1.0, row[k]), row[k] < model.least[k]
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["key", "lang_pred", "score", "rejected"])

    out = T.StructType([rows.schema["key"]]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def identify(docs: DataFrame, labelled: DataFrame, per_lang: int = 400, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from ``labelled`` (a bounded sample: about ``per_lang`` rows a language) and predict every row of ``docs``."""
    texts, labels = sample(labelled, per_lang, text, label, key)
    return predict(docs, train(texts, labels) if texts else None, text, key)
