"""Names: collision forms, suffix stripping, search forms, credit strings, last names, slugs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that end company names, and the legal ones among them.
LEGAL_SUFFIXES = (r"Incorporated", r"Limited", r"Inc\.?", r"Ltd\.?", r"Co\.?", r"LLC", r"GmbH", r"S\.?A\.?", r"s\.?p\.?a\.?")
BUSINESS_SUFFIXES = ("Manufacturing", "Electronics", "Industries", "Enterprises", "Games", "Pinball", "Technologies", "Company", "Corporation", *LEGAL_SUFFIXES)
# Words that stand for no person in credits.
NO_PERSON = ("undisclosed", "unknown", "n/a", "none")


def fold_ascii(name: Column) -> Column:
    """Collision form of an ASCII name: lower case, other characters as single blanks, without a leading article."""
    spaced = F.trim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", " "))
    return F.trim(F.regexp_replace(spaced, r"^(?:the|a|an)\s+", ""))


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Letters without their diacritics."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


def collision_form(name: Column) -> Column:
    """Collision form of any name; only names beyond ASCII go through Python."""
    return F.when(name.rlike(r"[^\x00-\x7F]"), fold_ascii(compatible(name))).otherwise(fold_ascii(name))


def search_form(text: Column) -> Column:
    """Form for accent-blind search: no marks, no punctuation, single blanks, lower case."""
    bare = F.when(text.rlike(r"[^\x00-\x7F]"), without_marks(text)).otherwise(text)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))


def without_suffixes(name: Column, suffixes: tuple[str, ...] = BUSINESS_SUFFIXES) -> Column:
    """Lower-case name without the suffixes at its end, however many."""
    return F.lower(F.trim(F.regexp_replace(F.trim(name), r"(?i)(?:,?\s+(?:" + "|".join(suffixes) + r"))+\s*$", "")))


def base_name(name: Column) -> Column:
    """Without a parenthesis at the end."""
    return F.trim(F.regexp_replace(name, r"\s*\([^()]*\)\s*$", ""))


def last_name(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))


def credit_names(raw: Column) -> Column:
    """Persons of a comma-separated credit line: parentheses go, placeholders and blanks are no persons."""
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda p: F.trim(F.regexp_replace(p, r"\s*\([^)]*\)", "")))
    return F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*NO_PERSON))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens (ASCII; :func:`without_marks` first for others)."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def names_shown(names: Column, most: int = 10) -> Column:
    """The first names of an array, and how many there are if not all are shown."""
    head = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) <= most, head).otherwise(F.concat(head, F.lit(", ... ("), F.size(names).cast("string"), F.lit(" total)")))


def alias_form(name: Column) -> Column:
    """Form by which aliases are near duplicates: lower case, no hyphens or blanks, no plural s."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[-\s]", ""), "s$", "")


def theme_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def theme_slugs(raw: Column, whole_slug: Column) -> Column:
    """A known whole name is one theme; else parts between `` - `` and ``, `` are, each once, as slugs."""
    parts = F.transform(F.split(raw, " - |, "), lambda p: slug(p))
    return F.when(whole_slug.isNotNull(), F.array(whole_slug)).otherwise(F.array_distinct(F.filter(parts, lambda s: s != "")))
