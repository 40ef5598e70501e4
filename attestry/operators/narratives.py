"""Features named in running text: rules give scored spans, overlapping spans are settled by the choice of greatest weight, general terms give way to
special ones, and number words have values.

A rule is a pattern with a slug and a weight. A rule whose slug holds ``{n}`` counts: its pattern is the noun, and the numbers in front of it, joined by commas,
"and" or "or", give one slug each ("two-ball and 3 ball multiball": 2-ball-multiball, 3-ball-multiball); a slug that the vocabulary lacks is the rule's
``otherwise``. Texts are searched in lower case.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Number words.
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
OTHER = {"a pair of": 2, "a couple of": 2, "a dozen": 12}

_WORD = "(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")"
_TEN = f"(?:(?:{'|'.join(TENS)})(?:[- ]{_WORD})?)"
#: digits; hundreds, tens and units in words; a pair, a dozen
NUMBER = rf"(?:[0-9]{{1,6}}|(?:{_WORD} hundred(?: and)?(?: (?:{_TEN}|{_WORD}))?)|{_TEN}|{_WORD}|{'|'.join(OTHER)})"


@dataclass(frozen=True)
class Rule:
    pattern: str
    slug: str
    weight: int = 1
    #: for counting rules: the slug where the counted one isn't in the vocabulary, and what may stand between number and noun
    otherwise: str | None = None
    unit: str = ""

    @property
    def counts(self) -> bool:
        return "{n}" in self.slug

    def regex(self) -> str:
        if not self.counts:
            return rf"\b(?:{self.pattern})\b"
        one = rf"{NUMBER}(?:[- ]?{self.unit})?" if self.unit else NUMBER
        return rf"\b{one}(?:(?:,| and| or|, and|, or) {one})* (?:{self.pattern})\b"


def number(text: Column) -> Column:
    """The value of a number in digits or words, null if it is none."""
    text = F.regexp_replace(F.trim(text), r"\band\b", " ")
    values = F.create_map(*[F.lit(x) for kv in {**UNITS, **TENS}.items() for x in kv])
    whole = F.create_map(*[F.lit(x) for kv in OTHER.items() for x in kv])
    words = F.filter(F.split(text, r"[-\s]+"), lambda w: w != "")
    sum_ = F.aggregate(words, F.lit(0), lambda n, w: F.when(w == "hundred", n * 100).otherwise(n + F.try_element_at(values, w)))
    return F.coalesce(F.try_element_at(whole, text), text.try_cast("int"), F.when(F.size(words) > 0, sum_))


def spans(rows: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, begin, end, found) of every match of every rule; places count characters from 0, ends are exclusive."""
    lower = rows.select(key, F.lower(text).alias("_t")).filter("_t IS NOT NULL AND _t <> ''")
    cut = []
    for i, r in enumerate(rules):
        pieces, hits = F.split("_t", r.regex()), F.regexp_extract_all("_t", F.lit(r.regex()), F.lit(0))
        cut.append(F.when(F.rlike("_t", F.lit(r.regex())), F.struct(F.lit(i).alias("rule"), pieces.alias("pieces"), hits.alias("hits"))))
    each = lower.select(key, F.explode(F.filter(F.array(*cut), lambda x: x.isNotNull())).alias("c"))
    parts = each.select(key, "c.rule", F.posexplode(F.arrays_zip(F.transform("c.pieces", lambda p: F.length(p)).alias("gap"), F.col("c.hits").alias("found"))).alias("i", "x")).select(key, "rule", "i", "x.gap", "x.found")
    order = W.partitionBy(key, "rule").orderBy("i")
    gone = F.coalesce(F.sum(F.col("gap") + F.length(F.coalesce("found", F.lit("")))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("begin", (gone + F.col("gap")).cast("int")).filter("found IS NOT NULL")
    return placed.select(key, "rule", "begin", (F.col("begin") + F.length("found")).alias("end"), "found")


def heaviest(items: list[tuple[int, int, int]]) -> list[int]:
    """Of (begin, end, weight) the places of a set without overlaps whose weight is greatest; of several, the one that ends its spans earliest."""
    order = sorted(range(len(items)), key=lambda i: (items[i][1], items[i][0], i))
    ends = [items[i][1] for i in order]
    best, taken = [0], []
    for n, i in enumerate(order):
        begin, _, weight = items[i]
        before = bisect_right(ends, begin, 0, n)
        take = weight + best[before] > best[n]
        taken.append((take, before))
        best.append(weight + best[before] if take else best[n])
    out, n = [], len(order)
    while n:
        take, before = taken[n - 1]
        if take:
            out.append(order[n - 1])
        n = before if take else n - 1
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _heaviest(spans_: pd.Series) -> pd.Series:
    return spans_.map(lambda s: heaviest([(x["begin"], x["end"], x["weight"]) for x in s]))


def settled(found: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """Spans without overlaps. A span's weight is its rule's and grows with its length, so that of rules of one weight the longer reading wins."""
    weights = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r.weight))])
    weight = F.element_at(weights, F.col("rule")) * (F.col("end") - F.col("begin"))
    group = found.withColumn("weight", weight).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "rule", "found", "weight"))).alias("s"))
    kept = group.withColumn("at", _heaviest("s")).select(key, F.explode(F.transform("at", lambda i: F.get("s", i))).alias("x"))
    return kept.select(key, "x.rule", "x.begin", "x.end", "x.found")


def features(rows: DataFrame, key: str, text: str, rules: list[Rule], vocabulary: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(key, slug, n, begin): the slugs that a text names, how often and where first. ``vocabulary`` (slug) has what there is; ``parents`` (slug, parent)
    makes a slug give way where one below it, at any depth that is listed, is named in the same text."""
    kept = settled(spans(rows, key, text, rules), key, rules)
    table = F.array(*[F.struct(F.lit(r.slug).alias("slug"), F.lit(r.otherwise).cast("string").alias("otherwise"), F.lit(r.counts).alias("counts")) for r in rules])
    named = kept.withColumn("r", F.get(table, F.col("rule")))
    numbers = F.transform(F.regexp_extract_all("found", F.lit(rf"\b{NUMBER}\b"), F.lit(0)), number)
    counted = named.withColumn("value", F.explode(F.when(F.col("r.counts"), numbers).otherwise(F.array(F.lit(None).cast("int")))))
    slug = F.when(F.col("r.counts"), F.replace(F.col("r.slug"), F.lit("{n}"), F.col("value").cast("string"))).otherwise(F.col("r.slug"))
    known = vocabulary.select(F.col("slug").alias("_slug")).distinct().withColumn("_known", F.lit(True))
    told = counted.withColumn("slug", slug).join(known, F.col("slug") == F.col("_slug"), "left")
    told = told.withColumn("slug", F.when(F.col("_known"), F.col("slug")).otherwise(F.col("r.otherwise"))).filter("slug IS NOT NULL")
    out = told.groupBy(key, "slug").agg(F.count(F.lit(1)).alias("n"), F.min("begin").alias("begin"))
    if parents is None:
        return out
    below = out.select(key, "slug").join(parents.select("slug", F.col("parent").alias("_p")), "slug").select(key, F.col("_p").alias("slug")).distinct()
    return out.join(below, [key, "slug"], "left_anti")
