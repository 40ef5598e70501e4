"""Parsing of single values: dates of several precisions, company lines, places, ids, ISBN and URL inputs, HTML heads, encoding checks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Technology and display codes, and what they stand for.
TECHNOLOGY = {"em": "electromechanical", "ss": "solid-state", "me": "pure-mechanical"}
DISPLAY = {"reels": "score-reels", "alphanumeric": "alphanumeric", "dmd": "dot-matrix", "lcd": "lcd", "lights": "backglass-lights", "cga": "cga"}
# Precision codes of knowledge-graph dates.
DAY, MONTH, YEAR = 11, 10, 9


def whole(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def dated(text: Column) -> Column:
    """(year, month) of a date that begins with YYYY-MM."""
    return F.struct(F.try_to_number(whole(text, r"^(\d{4})-\d{2}"), F.lit("9999")).cast("int").alias("year"), whole(text, r"^\d{4}-(\d{2})").try_cast("int").alias("month"))


def dated_or_year(text: Column) -> Column:
    """As :func:`dated`, but the first of January at midnight only stands for the year."""
    d = dated(text)
    return F.struct(d["year"].alias("year"), F.when(~((d["month"] == 1) & text.endswith("01-01T00:00:00")), d["month"]).alias("month"))


def precise_date(text: Column, precision: Column) -> Column:
    """(year, month, day) as far as the precision goes; years before the era are negative."""
    date = F.regexp_replace(F.split_part(text, F.lit("T"), F.lit(1)), r"^\+", "")
    parts = F.split(F.regexp_replace(date, "^-", ""), "-")
    number = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]
    # a part that is no number spoils the date
    good = number[0].isNotNull() & F.when(F.size(parts) > 1, number[1].isNotNull()).otherwise(True) & F.when(F.size(parts) > 2, number[2].isNotNull()).otherwise(True)
    fine = F.coalesce(precision, F.lit(DAY))
    year = F.when(date.startswith("-"), -number[0]).otherwise(number[0])
    return F.struct(
        F.when(good & (fine >= YEAR), year).alias("year"), F.when(good & (fine >= MONTH), number[1]).alias("month"), F.when(good & (fine > MONTH), number[2]).alias("day")
    )


def company_line(raw: Column) -> Column:
    """``Name, of Place (years) [Trade Name: X]`` to company_name, trade_name, years_active, location ('' where absent).

    The line is a name followed by marked parts; each part runs from its mark to the next one."""
    raw = F.coalesce(raw, F.lit(""))
    # a separator in front of each mark, so that the line falls into its parts
    cut = F.regexp_replace(raw, r"(?=\[Trade Name:)|(?=\([0-9]{4})|(?=, *of )", "\u0001")
    parts = F.transform(F.split(cut, "\u0001"), lambda p: F.trim(p))

    def marked(mark: str) -> Column:
        return F.coalesce(F.get(F.filter(parts, lambda p: p.rlike(mark)), F.lit(0)), F.lit(""))

    years = F.substring_index(F.ltrim(marked("^[(]"), F.lit("(")), ")", 1)
    return F.struct(
        F.rtrim(F.trim(F.when(parts[0].rlike("^(\\[|[(]|, *of )"), "").otherwise(parts[0])), F.lit(",")).alias("company_name"),
        F.trim(F.substring_index(F.substring_index(marked("^\\[Trade"), ":", -1), "]", 1)).alias("trade_name"),
        F.when(years.rlike("^[0-9]{4}(-([0-9]{4}|present))?$"), years).otherwise("").alias("years_active"),
        F.rtrim(F.trim(F.regexp_replace(marked("^, *of "), "^, *of ", "")), F.lit(",")).alias("location"),
    )


def place(raw: Column, home_states: list[str], home: str = "USA") -> Column:
    """``City, State, Country`` with parts missing: a last part that is a home state has the home country."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s*\([^)]*\)\s*$", ""), ","), lambda p: F.trim(p))
    n, last, none = F.size(parts), F.element_at(parts, -1), F.lit("")
    state = last.isin(*home_states)
    return F.struct(
        F.when(n > 1, parts[0]).otherwise(none).alias("city"),
        F.when(n > 2, parts[1]).when(state, last).otherwise(none).alias("state"),
        F.when(n > 2, parts[2]).when(state, F.lit(home)).otherwise(last).alias("country"),
    )


def mapped(code: Column, table: dict[str, str]) -> Column:
    """A code's meaning, '' where unknown."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(code))), F.lit(""))


def group_of(id_: Column) -> Column:
    """First segment of ``group-machine-alias``."""
    return F.coalesce(F.substring_index(id_, "-", 1), F.lit(""))


def parent_of(id_: Column) -> Column:
    """All but the last segment, null for a group."""
    return F.nullif(F.regexp_replace(id_, "-?[^-]*$", ""), F.lit(""))


def isbn(raw: Column) -> Column:
    bare = F.upper(F.translate(raw, "- ", ""))
    return F.when(bare.rlike(r"^(?:[0-9]{13}|[0-9]{9}[0-9X])$"), bare)


def evidence_kind(raw: Column) -> Column:
    """isbn, url or null; an ISBN wins."""
    return F.when(isbn(raw).isNotNull(), "isbn").when(F.trim(raw).rlike(r"^https?://[^/?#]"), "url")


def year_in(text: Column) -> Column:
    """The first four digits that stand apart from other digits."""
    return whole(text, r"(?<![0-9])([0-9]{4})(?![0-9])").cast("int")


def host(url: Column) -> Column:
    """Host of a URL, lower case, without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def head(page: Column) -> Column:
    """title, og_title and site_name from an HTML head ('' where absent)."""
    top = F.regexp_extract(page, r"(?is)^(.*?)(?:<body\b|</head>|$)", 1)

    def meta(name: str) -> Column:
        tag = F.regexp_extract(top, rf"(?is)<meta\b([^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*)>", 1)
        return F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)

    return F.struct(F.trim(F.regexp_extract(top, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), meta("og:title").alias("og_title"), meta("og:site_name").alias("site_name"))


def image_sources(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r"(?i)<img[^>]*\bsrc=[\"']([^\"']+)[\"']"), F.lit(1)))


@F.pandas_udf(T.BooleanType())
def garbled(text: pd.Series) -> pd.Series:
    """Text that was decoded with the wrong table: encoding it back gives other, valid UTF-8; or a replacement character."""

    def bad(s: str | None) -> bool:
        if not s:
            return False
        if "�" in s:
            return True
        for table in ("cp1252", "latin-1"):
            try:
                if s.encode(table).decode("utf-8") != s:
                    return True
            except UnicodeError:
                pass
        return False

    return text.map(bad)


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda s: None if s is None else html.unescape(s))


def is_true(text: Column) -> Column:
    return F.lower(text).isin("true", "1", "yes")


def years_label(first: Column, last: Column) -> Column:
    """``1980``, ``1980-1985`` or null."""
    return F.when(first.isNull() | last.isNull() | (first == last), F.coalesce(first, last).cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def excerpt(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
