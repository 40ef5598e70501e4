"""Faceted search over documents with scalar and array dimensions: filters, counts that leave out a facet's own filter, options."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str
    #: scalar, any (array holds one of the chosen), all (array holds each chosen), range (overlaps the span), atleast, text
    kind: str = "scalar"
    #: for range: columns of first and last value; for text: columns searched
    columns: tuple[str, ...] = ()

    def test(self, chosen) -> Column:
        c = F.col(self.column) if self.column else None
        if self.kind == "scalar":
            return F.coalesce(c.isin(*chosen) if isinstance(chosen, (list, tuple)) else c == chosen, F.lit(False))
        if self.kind == "any":
            return F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(x) for x in chosen])), F.lit(False))
        if self.kind == "all":
            return F.coalesce(F.size(F.array_except(F.array(*[F.lit(x) for x in chosen]), c)) == 0, F.lit(False))
        if self.kind == "range":
            return overlaps(F.col(self.columns[0]), F.col(self.columns[1]), *chosen)
        if self.kind == "atleast":
            return F.coalesce(c >= chosen, F.lit(False))
        if self.kind == "text":
            return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(x)).contains(str(chosen).lower()), F.lit(False)) for x in self.columns])
        raise ValueError(self.kind)


def overlaps(first: Column, last: Column, low=None, high=None) -> Column:
    """Whether [first, last] and [low, high] meet; an end that is missing is the other one (of a row) or open (of the query)."""
    a, z = F.coalesce(first, last), F.coalesce(last, first)
    known = a.isNotNull()
    out = known
    if low is not None:
        out = out & (z >= low)
    if high is not None:
        out = out & (a <= high)
    return F.coalesce(out, F.lit(False))


@dataclass
class FilterState:
    """Chosen values by dimension; to and from URL parameters."""

    chosen: dict[str, object] = field(default_factory=dict)

    @classmethod
    def from_query(cls, query: str, dimensions: list[Dimension]) -> FilterState:
        got, out = parse_qs(query.lstrip("?")), {}
        for d in dimensions:
            if d.kind == "range":
                ends = [int(got[k][0]) if k in got and got[k][0].lstrip("-").isdigit() else None for k in (f"{d.name}_min", f"{d.name}_max")]
                if ends != [None, None]:
                    out[d.name] = tuple(ends)
            elif d.name in got:
                out[d.name] = got[d.name] if d.kind in ("any", "all") else float(got[d.name][0]) if d.kind == "atleast" else got[d.name][0]
        return cls(out)

    def to_query(self) -> str:
        pairs = []
        for name, v in self.chosen.items():
            if isinstance(v, tuple):
                pairs += [(f"{name}_{end}", x) for end, x in zip(("min", "max"), v, strict=True) if x is not None]
            else:
                pairs += [(name, x) for x in (v if isinstance(v, list) else [v])]
        return urlencode(pairs)


def tests(dimensions: list[Dimension], state: FilterState) -> dict[str, Column]:
    by = {d.name: d for d in dimensions}
    return {name: by[name].test(value) for name, value in state.chosen.items()}


def filtered(docs: DataFrame, dimensions: list[Dimension], state: FilterState) -> DataFrame:
    return reduce(lambda df, t: df.filter(t), tests(dimensions, state).values(), docs)


def counts(docs: DataFrame, dimensions: list[Dimension], state: FilterState, counted: list[str], bucket: dict[str, Column] | None = None) -> DataFrame:
    """(dimension, value, n): for each value of each counted dimension the documents that pass all filters but the dimension's own.

    One pass: every filter is a bit of a mask, a row is spread into its (dimension, value) pairs, and a pair counts where the mask has all bits
    but perhaps its own. Distinct values of an array count once."""
    by, bits = {d.name: d for d in dimensions}, list(state.chosen)
    mask = reduce(lambda a, b: a + b, [F.when(t, 1 << bits.index(n)).otherwise(0) for n, t in tests(dimensions, state).items()], F.lit(0))
    full = (1 << len(bits)) - 1

    def named(name: str):
        return lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))

    pairs = []
    for name in counted:
        column = (bucket or {}).get(name, F.col(by[name].column))
        need = full & ~(1 << bits.index(name)) if name in bits else full
        array = by[name].kind in ("any", "all")
        values = F.array_distinct(F.transform(column, lambda x: x.cast("string"))) if array else F.array(column.cast("string"))
        pairs.append(F.when(F.col("_mask").bitwiseAND(need) == need, F.transform(F.filter(values, lambda x: x.isNotNull()), named(name))))
    spread = docs.withColumn("_mask", mask).select(F.explode(F.flatten(F.filter(F.array(*pairs), lambda x: x.isNotNull()))).alias("p"))
    return spread.groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def options(docs: DataFrame, dimensions: list[Dimension], state: FilterState, counted: list[str]) -> DataFrame:
    """As :func:`counts`, but every value that any document has appears, with 0 where nothing is left."""
    every = counts(docs, dimensions, FilterState(), counted).select("dimension", "value")
    return every.join(counts(docs, dimensions, state, counted), ["dimension", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def capped_bucket(n: Column, cap: int = 6) -> Column:
    """Numbers from ``cap`` on are one bucket."""
    return F.when(n >= cap, cap).otherwise(n)


def player_buckets(numbers: Column, shown: tuple[int, ...] = (1, 2, 4), cap: int = 6) -> Column:
    """Buckets a row counts in: shown numbers as they are, each one from ``cap`` on as the cap, others not at all. A row with two numbers
    from the cap on counts twice in it (array_distinct gives the corrected variant)."""
    kept = F.filter(numbers, lambda x: x.isin(*shown) | (x >= cap))
    return F.transform(kept, lambda x: F.when(x >= cap, cap).otherwise(x))


def search_text(*parts: Column, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *parts)


def matching(docs: DataFrame, query: str, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Rows with a column, or a member of an array, that holds the query (case-blind); a query of one character matches nothing."""
    if len(query.strip()) < 2:
        return docs.limit(0)
    q = query.strip().lower()
    hit = [F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in columns]
    hit += [F.coalesce(F.exists(F.col(a), lambda x: F.lower(x).contains(q)), F.lit(False)) for a in arrays]
    return docs.filter(reduce(lambda a, b: a | b, hit))


def rolled_up(children: DataFrame, parents: DataFrame, query: str, child_columns: list[str], parent_columns: list[str], parent_key: str) -> DataFrame:
    """Parents that match or have a child that does."""
    through = matching(children, query, child_columns).select(parent_key).distinct()
    return parents.join(through, parent_key, "left_semi").unionByName(matching(parents, query, parent_columns)).dropDuplicates([parent_key])
