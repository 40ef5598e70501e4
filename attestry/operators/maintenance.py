"""Incremental maintenance of what is materialized from claims.

Columns depend on one another: a claimed field gives a column, a field that names another entity gives that entity's id (and changes with the name it is
looked up by), a copied column follows an id to a column of the other entity, a roll-up counts members under a node of a hierarchy. From the claims that
were touched, these edges are walked: along ids the other way round, and up the hierarchy, as it was and as it is. Only rows that are reached
are computed again, and only columns that really changed carry on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.specs import EntitySpec
from ._shared import stored
from .hierarchy import closure
from .resolve import in_dependency_order, wide


@dataclass(frozen=True)
class Copy:
    """``entity.column`` is the column ``of`` of the entity that the field ``via`` names."""

    entity: str
    column: str
    via: str
    of: str


@dataclass(frozen=True)
class Rollup:
    """``entity.column`` counts the rows of ``member`` whose field ``place`` names the entity or one below it, by the entity's field ``parent``."""

    entity: str
    column: str
    parent: str
    member: str
    place: str


Derived = Copy | Rollup


def edges(specs: list[EntitySpec], derived: list[Derived]) -> list[tuple[tuple[str, str], tuple[str, str], str]]:
    """The dependency graph: ((entity, column) that changes, (entity, column) to look at, by which way)."""
    of = {s.name: s for s in specs}
    out = []
    for s in specs:
        for f in s.fields:
            if f.target in of:
                out += [((s.name, f.name), (s.name, f"{f.name}_id"), "same row"), ((f.target, f.lookup), (s.name, f"{f.name}_id"), "rows that name the old or new value")]
    for d in derived:
        if isinstance(d, Copy):
            target = of[d.entity].field(d.via).target
            out += [((d.entity, f"{d.via}_id"), (d.entity, d.column), "same row"), ((target, d.of), (d.entity, d.column), "rows with that id")]
        else:
            out += [((d.member, f"{d.place}_id"), (d.entity, d.column), "ancestors of the old and new place"), ((d.entity, f"{d.parent}_id"), (d.entity, d.column), "old and new ancestors")]
    return out


class Changing:
    """A table as it was and the rows of it that differ now."""

    def __init__(self, before: DataFrame):
        self.before, self.rows = before, before.limit(0)

    def now(self) -> DataFrame:
        return self.before.join(self.rows.select("entity_id"), "entity_id", "left_anti").unionByName(self.rows)

    def replace(self, rows: DataFrame) -> None:
        """``rows``: whole rows that replace those of the same id, or are new."""
        rows = rows.select(*self.before.columns)
        self.rows = stored(self.rows.join(rows.select("entity_id"), "entity_id", "left_anti").unionByName(rows), "changing")

    def put(self, ids: DataFrame, column: str, values: DataFrame) -> None:
        """``column`` of the rows ``ids`` becomes their ``value`` in ``values`` (entity_id, value), null where there is none."""
        rows = self.now().join(ids, "entity_id", "left_semi").drop(column).join(values.withColumnRenamed("value", column), "entity_id", "left")
        self.replace(rows)

    def changed(self, column: str) -> DataFrame:
        """(entity_id, old, new) of rows whose column differs."""
        old = self.before.select("entity_id", F.col(column).alias("old"))
        both = self.rows.select("entity_id", F.col(column).alias("new")).join(old, "entity_id", "left")
        return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def _full_rollup(d: Rollup, nodes: DataFrame, members: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(entity_id, value) of all nodes, or of those in ``of``."""
    tree = nodes.filter(F.col(f"{d.parent}_id").isNotNull()).select(F.col("entity_id").alias("child"), F.col(f"{d.parent}_id").alias("parent"))
    if of is None:
        below = closure(tree).select(F.col("ancestor").alias("entity_id"), F.col("descendant").alias("node"))
        below = below.unionByName(nodes.select("entity_id", F.col("entity_id").alias("node"))).distinct()
    else:
        below = stored(of.select("entity_id", F.col("entity_id").alias("node")), "below")
        front = below
        while not front.isEmpty():
            found = front.join(tree, F.col("node") == F.col("parent")).select("entity_id", F.col("child").alias("node")).distinct()
            front = stored(found.join(below, ["entity_id", "node"], "left_anti"), "below")
            below = below.unionByName(front)
    held = members.select(F.col(f"{d.place}_id").alias("node"), F.col("entity_id").alias("_m")).filter("node IS NOT NULL")
    # a node below two of the same is one pair, so members are distinct without asking
    return below.join(held, "node").groupBy("entity_id").agg(F.count("_m").alias("value"))


def _ids(rows: DataFrame, spec: EntitySpec, name: str, targets: DataFrame) -> DataFrame:
    f = spec.field(name)
    dim = targets.filter(F.col(f.lookup).isNotNull()).groupBy(F.col(f.lookup).alias("_key")).agg(F.min("entity_id").alias("value"))
    return rows.select("entity_id", F.col(name).alias("_key")).join(dim, "_key").select("entity_id", "value")


def materialized(won: DataFrame, specs: list[EntitySpec], derived: list[Derived], entities: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables from scratch: entity_id, fields, ``<field>_id`` and derived columns. ``entities`` has the ids (and preserved fields) of each kind."""
    of = {s.name: s for s in specs}
    out = {s.name: wide(won, s, entities[s.name]) for s in in_dependency_order(specs)}
    base = dict(out)
    for s in specs:
        for f in s.fields:
            if f.target in of:
                ids = _ids(base[s.name], s, f.name, base[f.target]).withColumnRenamed("value", f"{f.name}_id")
                out[s.name] = out[s.name].join(ids, "entity_id", "left")
    for d in derived:
        if isinstance(d, Copy):
            target = out[of[d.entity].field(d.via).target].select(F.col("entity_id").alias(f"{d.via}_id"), F.col(d.of).alias(d.column))
            out[d.entity] = out[d.entity].join(target, f"{d.via}_id", "left")
        else:
            n = _full_rollup(d, out[d.entity], out[d.member]).withColumnRenamed("value", d.column)
            out[d.entity] = out[d.entity].join(n, "entity_id", "left").withColumn(d.column, F.coalesce(d.column, F.lit(0).cast("bigint")))
    return out


def maintained(won: DataFrame, specs: list[EntitySpec], derived: list[Derived], touched: DataFrame, before: dict[str, DataFrame]) -> dict[str, Changing]:
    """The tables after claims were ``touched`` (entity_type, entity_id, field_name): of each, what it was and the rows that are computed anew. ``won`` has
    the winners of at least the touched entities; ``before`` the tables of :func:`materialized`, or of an earlier run."""
    of = {s.name: s for s in specs}
    tables = {s.name: Changing(before[s.name]) for s in specs}
    touched = stored(touched.select("entity_type", "entity_id", "field_name").distinct(), "touched")
    for s in specs:
        hit = touched.filter((F.col("entity_type") == s.name) & (F.col("field_name").isin(*[f.name for f in s.fields]) | F.lit(s.extra))).select("entity_id").distinct()
        was = hit.join(before[s.name], "entity_id", "left")
        rows = wide(won.join(hit, "entity_id", "left_semi"), s, was)
        more = [c for c in before[s.name].columns if c not in rows.columns]
        tables[s.name].replace(rows.join(was.select("entity_id", *more), "entity_id", "left"))

    for s in specs:
        for f in s.fields:
            if f.target in of:
                mine, theirs = tables[s.name], tables[f.target]
                renamed = theirs.changed(f.lookup)
                values = renamed.select(F.col("old").alias("_v")).unionByName(renamed.select(F.col("new").alias("_v"))).filter("_v IS NOT NULL").distinct()
                ids = mine.changed(f.name).select("entity_id").unionByName(mine.now().join(values, F.col(f.name) == F.col("_v"), "left_semi").select("entity_id"))
                ids = stored(ids.distinct(), "ids")
                mine.put(ids, f"{f.name}_id", _ids(mine.now().join(ids, "entity_id", "left_semi"), s, f.name, theirs.now()))
    for d in derived:
        mine = tables[d.entity]
        if isinstance(d, Copy):
            theirs, key = tables[of[d.entity].field(d.via).target], f"{d.via}_id"
            through = mine.now().join(theirs.changed(d.of).select(F.col("entity_id").alias(key)), key, "left_semi").select("entity_id")
            ids = stored(mine.changed(key).select("entity_id").unionByName(through).distinct(), "ids")
            values = mine.now().join(ids, "entity_id", "left_semi").select("entity_id", key).join(theirs.now().select(F.col("entity_id").alias(key), F.col(d.of).alias("value")), key)
            mine.put(ids, d.column, values.select("entity_id", "value"))
        else:
            parent, moved, turned = f"{d.parent}_id", tables[d.member].changed(f"{d.place}_id"), mine.changed(f"{d.parent}_id")
            new = mine.rows.join(mine.before.select("entity_id"), "entity_id", "left_anti").select(F.col("entity_id").alias("node"))
            start = [c.select(F.col(e).alias("node")) for c in (moved, turned) for e in ("old", "new")] + [new]
            front = start[0]
            for more in start[1:]:
                front = front.unionByName(more)
            front = reached = stored(front.filter("node IS NOT NULL").distinct(), "reached")
            tree = mine.before.select(F.col("entity_id").alias("node"), F.col(parent).alias("up")).unionByName(mine.now().select(F.col("entity_id").alias("node"), F.col(parent).alias("up")))
            tree = stored(tree.filter("up IS NOT NULL").distinct(), "tree")
            while not front.isEmpty():
                found = front.join(tree, "node").select(F.col("up").alias("node")).distinct()
                front = stored(found.join(reached, "node", "left_anti"), "reached")
                reached = reached.unionByName(front)
            ids = stored(mine.now().join(reached.withColumnRenamed("node", "entity_id"), "entity_id", "left_semi").select("entity_id"), "ids")
            n = _full_rollup(d, mine.now(), tables[d.member].now(), ids)
            values = ids.join(n, "entity_id", "left").select("entity_id", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
            mine.put(ids, d.column, values)
    return tables
