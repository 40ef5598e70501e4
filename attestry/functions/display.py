"""What pages show: references, options, images with their licence, attribution, orders, dates, changed fields, word differences."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def reference(slug: Column, name: Column) -> Column:
    """A struct of slug and name, null where nothing is referred to."""
    return F.when(slug.isNotNull(), F.struct(slug.alias("slug"), name.alias("name")))


def options(rows: DataFrame, value: str, label: str, order: str | None = None) -> DataFrame:
    """Choices of an edit form (value, label, place) by display order, then name."""
    by = [F.asc_nulls_last(order)] if order else []
    place = F.row_number().over(W.orderBy(*by, F.lower(label), value))  # a vocabulary, small by nature
    return rows.select(F.col(value).alias("value"), F.col(label).alias("label"), place.alias("place"))


def absolute(url: Column) -> Column:
    """The address if it is a whole one."""
    return F.when(url.rlike("^https?://[^/]"), url)


def first_where(items: Column, test) -> Column:
    """The first item that passes, null if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def chosen_image(uploads: Column, images: Column, urls: Column, least_rank: int, unknown: int = 5) -> Column:
    """Address of the image to show: an uploaded one of category backglass, any uploaded one, a structured one (primary first; large, medium, small),
    the first of a flat list. Uploads need a licence of at least ``least_rank``; only whole addresses count.

    ``uploads``: array of (category, url, rank); ``images``: array of (primary, large, medium, small, rank); ``urls``: array of strings."""

    def shown(x: Column) -> Column:
        return F.coalesce(x["rank"], F.lit(unknown)) >= least_rank

    def size(x: Column) -> Column:
        return F.coalesce(absolute(x["large"]), absolute(x["medium"]), absolute(x["small"]))

    uploaded = F.filter(uploads, lambda x: shown(x) & absolute(x["url"]).isNotNull())
    structured = F.filter(images, lambda x: shown(x) & size(x).isNotNull())
    best = F.coalesce(first_where(structured, lambda x: F.coalesce(x["primary"], F.lit(False))), F.get(structured, F.lit(0)))
    return F.coalesce(
        first_where(uploaded, lambda x: x["category"] == "backglass")["url"], F.get(uploaded, F.lit(0))["url"], size(best), F.get(F.filter(F.transform(urls, absolute), lambda u: u.isNotNull()), F.lit(0))
    )


def attribution(sources: list[tuple[Column, Column, Column]], least_rank: int, unknown: int = 5) -> Column:
    """(value, licence) of the first of several (value, licence name, rank) that is there and may be shown."""
    return F.coalesce(*[F.when(value.isNotNull() & (F.coalesce(rank, F.lit(unknown)) >= least_rank), F.struct(value.alias("value"), name.alias("license"))) for value, name, rank in sources])


def text_attribution(won: DataFrame, licenses: DataFrame, sources: DataFrame, field: str = "description") -> DataFrame:
    """Who the winning text of each entity is from: (entity_type, entity_id, value, source, license, rank). Winners have effective_license_id."""
    texts = won.filter(F.col("field_name") == field)
    named = texts.join(sources.select("source_id", F.col("slug").alias("source")), "source_id", "left")
    kept = licenses.select(F.col("license_id").alias("effective_license_id"), F.col("name").alias("license"), "rank")
    return named.join(kept, "effective_license_id", "left").select("entity_type", "entity_id", "value", "source", "license", "rank")


def orderings(named: dict[str, list[Column]], wanted: str | None, fallback: str) -> list[Column]:
    """Columns of a named order; an unknown name gives the fallback."""
    return named.get(wanted or fallback, named[fallback])


def overridden(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    """The value's entry in a fixed table, else ``otherwise``."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, value), otherwise)


def same_json(a: Column, b: Column) -> Column:
    """Equal as JSON values, whatever the order of keys: compared as variants in one written form."""
    return _canonical(a).eqNullSafe(_canonical(b))


@F.pandas_udf(T.StringType())
def _canonical(text: pd.Series) -> pd.Series:
    import json

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        try:
            return json.dumps(json.loads(s), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return s

    return text.map(one)


def changed(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Names of the fields that differ, in order; blank and not-a-number are the same as unset."""

    def plain(c: Column) -> Column:
        text = c.cast("string")
        return F.when(~text.isin("", "NaN"), text)

    marks = [F.when(~plain(before[n]).eqNullSafe(plain(after[n])), F.lit(n)) for n in sorted(after)]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def relative_date(at: Column, now: Column) -> Column:
    """just now, minutes, hours, days; then the date, without the year within the year."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)

    def ago(n: Column, unit: str) -> Column:
        n = F.floor(n)
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    same = F.year(at) == F.year(now)
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, ago(seconds / 60, "minute")).when(seconds < 86_400, ago(seconds / 3600, "hour")).when(seconds < 7 * 86_400, ago(seconds / 86_400, "day"))
        .when(same, F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))
    )


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])))
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Runs of words that two texts share (same), only the first has (del) or only the second (ins)."""

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y, out = (a or "").split(), (b or "").split(), []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag == "equal":
                out.append({"op": "same", "text": " ".join(x[i:j])})
                continue
            out += [{"op": op, "text": " ".join(w)} for op, w in (("del", x[i:j]), ("ins", y[k:m])) if w]
        return out

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def filter_labels(state: dict[str, object], names: dict[str, dict[str, str]]) -> list[tuple[str, str, str]]:
    """(dimension, value, label) of the filters in force, in their order: lists one by one, ranges as ``from – to``."""
    out = []
    for dimension, value in state.items():
        if value in (None, "", [], (None, None)):
            continue
        if isinstance(value, tuple):
            low, high = ("" if v is None else str(v) for v in value)
            out.append((dimension, f"{low}-{high}", f"{low} – {high}" if low and high else f"from {low}" if low else f"to {high}"))
            continue
        for v in value if isinstance(value, list) else [value]:
            out.append((dimension, str(v), names.get(dimension, {}).get(str(v), str(v))))
    return out
