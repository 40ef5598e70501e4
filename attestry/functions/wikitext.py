"""Wiki markup: templates with balanced braces, their fields, labelled credits, link targets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _template_at(text: str, begin: int) -> int:
    """Index behind the template that opens at ``begin``, -1 if it never closes."""
    depth = 0
    for m in re.compile(r"\{\{|\}\}").finditer(text, begin):
        depth += 1 if m.group() == "{{" else -1
        if depth == 0:
            return m.end()
    return -1


def _fields(text: str | None, name: str) -> dict[str, str] | None:
    if not text:
        return None
    at = re.search(r"\{\{\s*" + re.escape(name) + r"\b", text, re.I)
    end = _template_at(text, at.start()) if at else -1
    if end < 0:
        return None
    body, parts, depth, last = text[at.start() + 2 : end - 2], [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", body):
        if m.group() == "|":
            if depth == 0:
                parts.append(body[last : m.start()])
                last = m.end()
        else:
            depth += 1 if m.group() in ("{{", "[[") else -1
    parts.append(body[last:])
    pairs = (p.partition("=") for p in parts[1:] if "=" in p)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def template_fields(text: Column, name: str) -> Column:
    """Fields of the first template of a name (map, null where there is none); fields may hold templates and links."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _fields(t, name))

    return parse(text)


@F.pandas_udf(T.StringType())
def without_templates(text: pd.Series) -> pd.Series:
    """Text outside all templates; one that never closes stays."""

    def strip(t: str | None) -> str | None:
        if t is None:
            return None
        out, at = [], 0
        while (begin := t.find("{{", at)) >= 0 and (end := _template_at(t, begin)) >= 0:
            out.append(t[at:begin])
            at = end
        return "".join([*out, t[at:]])

    return text.map(strip)


def labelled_credits(field: Column) -> Column:
    """``'''Label''': a, b<br>...`` to an array of (role, name)."""
    lines = F.split(field, r"(?i)<br\s*/?>")
    return F.flatten(
        F.transform(
            lines,
            lambda x: F.transform(
                F.filter(F.split(F.regexp_replace(F.regexp_extract(x, r"'''.*?''':?\s*(.*)$", 1), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"), ","), lambda n: F.trim(n) != ""),
                lambda n: F.struct(F.rtrim(F.trim(F.regexp_extract(x, "'''(.*?)'''", 1)), F.lit(":")).alias("role"), F.trim(n).alias("name")),
            ),
        )
    )


def link_targets(text: Column) -> Column:
    """Distinct (type, ref) of ``[[type:ref]]`` links, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([a-z-]+:[^\]|]+)"), F.lit(1)))
    return F.transform(found, lambda x: F.struct(F.substring_index(x, ":", 1).alias("type"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("ref")))
