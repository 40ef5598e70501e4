"""The curated load as one command: a folder of exports to committed claims and resolved tables.

Kinds of entities are loaded in phases, in the order given: read the export (a missing file is an empty one), keep the first row of each slug, look up what rows
refer to, give ids to new slugs, make claims (fields, references, relationships, aliases), apply them to the store with a sweep of what the phase owns, each phase
as one version. Descriptions are kept back and said last, each by the source that its kind of entity goes to. In the end everything is resolved from the
winning claims and written as a snapshot.

The register of entities are the claims of ``slug``: what is there already keeps its id, so loading the same folder again changes nothing but commits
versions whose counts are all ``unchanged``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import loads as L
from ..operators import resolve as R
from ..operators._shared import scratch, stored
from ..plans.specs import EntitySpec, FieldSpec
from .readers import export
from .sinks import snapshot
from .store import ClaimStore


@dataclass(frozen=True)
class Ref:
    """A column of slugs that names an entity of ``target``. Missing ones: the row is left out (``row``), the reference is (``ref``), or all is refused (``abort``)."""

    column: str
    field: str
    target: str
    missing: str = "row"


@dataclass(frozen=True)
class Many:
    """An array column as relationship claims of ``namespace``: its members are slugs of ``target`` (or names, ``by``), plain values (no target), or structs whose fields
    ``parts`` (field to entity or None) are."""

    column: str
    namespace: str
    parts: dict[str, str | None]
    by: str = "slug"
    missing: str = "warn"
    payload: tuple[str, ...] = ()


@dataclass(frozen=True)
class Phase:
    entity: str
    file: str
    schema: str
    fields: tuple[str, ...]
    refs: tuple[Ref, ...] = ()
    many: tuple[Many, ...] = ()
    aliases: str | None = None
    #: makes further columns of the rows as they are read
    prepare: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Report:
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    created: dict[str, int] = field(default_factory=dict)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)
    snapshots: dict[str, str] = field(default_factory=dict)


def _array(name: str, of: str = "string") -> str:
    return f"{name} array<{of}>"


def _parents(rows: DataFrame) -> DataFrame:
    """A place's parent is its path without the last part; the parent's slug is what it is named by."""
    return rows.withColumns({"slug": F.col("location_path"), "parent_path": F.when(F.instr("location_path", "/") > 0, F.regexp_replace("location_path", "/[^/]*$", ""))})


def _taxonomy(entity: str, parent: str | None = None, more: str = "") -> Phase:
    columns = "slug string, name string, description string, display_order int" + (f", {parent}_slug string" if parent else "") + more
    return Phase(entity, entity, columns, ("name", "display_order", "description"), (Ref(f"{parent}_slug", parent, parent),) if parent else ())


CREDIT = "struct<person_slug:string,role:string>"
PHASES: tuple[Phase, ...] = (
    Phase("location", "location", "location_path string, name string, type string, code string, short_name string, " + _array("divisions") + ", " + _array("aliases"), ("name", "type", "code", "short_name"), (Ref("parent_path", "parent", "location"),), aliases="aliases", prepare=_parents),
    _taxonomy("technology_generation"), _taxonomy("technology_subgeneration", "technology_generation"), _taxonomy("display_type"), _taxonomy("cabinet"), _taxonomy("tag"), _taxonomy("credit_role"), _taxonomy("franchise"),
    Phase("reward_type", "reward_type", "slug string, name string, description string, " + _array("aliases"), ("name", "description"), aliases="aliases"),
    Phase("theme", "theme", "slug string, name string, description string, " + _array("parents") + ", " + _array("aliases"), ("name", "description"), many=(Many("parents", "theme_parent", {"parent": "theme"}, by="name"),), aliases="aliases"),
    Phase("gameplay_feature", "gameplay_feature", "slug string, name string, description string, " + _array("is_type_of") + ", " + _array("aliases"), ("name", "description"), many=(Many("is_type_of", "feature_parent", {"parent": "gameplay_feature"}, missing="abort"),), aliases="aliases"),
    Phase("manufacturer", "manufacturer", "slug string, name string, description string, external_id int", ("name", "description", "external_id")),
    Phase("corporate_entity", "corporate_entity", "slug string, name string, manufacturer_slug string, year_start int, year_end int, " + _array("locations") + ", " + _array("aliases"), ("name", "year_start", "year_end"), (Ref("manufacturer_slug", "manufacturer", "manufacturer"),), (Many("locations", "location", {"location": "location"}),), aliases="aliases"),
    Phase("system", "system", "slug string, name string, manufacturer_slug string, " + _array("mpu_strings"), ("name",), (Ref("manufacturer_slug", "manufacturer", "manufacturer", "ref"),), (Many("mpu_strings", "mpu_string", {"mpu": None}),)),
    Phase("person", "person", "slug string, name string, description string, " + _array("aliases"), ("name", "description"), aliases="aliases"),
    Phase("series", "series", "slug string, name string, description string, " + _array("credit_refs", CREDIT), ("name", "description")),
    Phase("title", "title", "slug string, name string, description string, opdb_group_id string, franchise_slug string, series_slug string, " + _array("abbreviations"), ("name", "description", "opdb_group_id"), (Ref("franchise_slug", "franchise", "franchise", "ref"), Ref("series_slug", "series", "series", "ref")), (Many("abbreviations", "abbreviation", {"value": None}),)),
    Phase(
        "model", "model",
        "slug string, name string, title_slug string, corporate_entity_slug string, year int, month int, player_count int, variant_of string, ipdb_id int, opdb_id string, system_slug string, "
        + ", ".join([_array("credit_refs", CREDIT), _array("tag_slugs"), _array("theme_slugs"), _array("gameplay_feature_slugs"), _array("reward_type_slugs")]),
        ("name", "year", "month", "player_count", "ipdb_id", "opdb_id"), (Ref("title_slug", "title", "title"), Ref("corporate_entity_slug", "corporate_entity", "corporate_entity", "ref"), Ref("variant_of", "variant_of", "model", "ref"), Ref("system_slug", "system", "system", "ref")),
        (Many("credit_refs", "credit", {"person_slug": "person", "role": "credit_role"}, missing="abort"), Many("tag_slugs", "tag", {"tag": "tag"}, missing="abort"), Many("theme_slugs", "theme", {"theme": "theme"}, missing="abort"),
         Many("gameplay_feature_slugs", "gameplay_feature", {"feature": "gameplay_feature"}, missing="abort"), Many("reward_type_slugs", "reward_type", {"reward": "reward_type"}, missing="abort")),
    ),
)
_TYPES = {"display_order": "int", "external_id": "int", "year_start": "int", "year_end": "int", "year": "int", "month": "int", "player_count": "int", "ipdb_id": "int"}


def specs(phases: tuple[Phase, ...] = PHASES) -> list[EntitySpec]:
    """Entities as the phases describe them: slugs are kept when nobody claims them, references are looked up by slug."""
    return [EntitySpec(p.entity, (FieldSpec("slug", preserve=True), *[FieldSpec(f, _TYPES.get(f, "string")) for f in p.fields], *[FieldSpec(r.field, target=r.target) for r in p.refs])) for p in phases]


def register(store: ClaimStore) -> DataFrame:
    """(entity_type, slug, entity_id) of all that was ever loaded."""
    claims = store.read("claims").filter("field_name = 'slug' AND is_active")
    return claims.groupBy("entity_type", F.col("value").alias("slug")).agg(F.min("entity_id").alias("entity_id"))


def _known(store: ClaimStore, of: str, by: str) -> DataFrame:
    """(key, slug) of the entities of a kind, by slug or by the name that is claimed."""
    have = register(store).filter(F.col("entity_type") == of)
    if by == "slug":
        return have.select(F.col("slug").alias("_key"), F.col("slug").alias("_slug"))
    names = store.read("claims").filter((F.col("entity_type") == of) & (F.col("field_name") == by) & F.col("is_active")).select("entity_id", F.lower("value").alias("_key"))
    return names.join(have, "entity_id").groupBy("_key").agg(F.min("slug").alias("_slug"))


class _Run:
    def __init__(self, spark: SparkSession, folder: str, store: ClaimStore, source_id: int):
        self.spark, self.folder, self.store, self.source, self.report = spark, folder.rstrip("/"), store, source_id, Report()
        self.late: list[DataFrame] = []

    def warn(self, phase: Phase, rows: DataFrame) -> None:
        """What was skipped and why: a curated folder has few such rows, and all of them are told."""
        self.report.warnings += [(phase.entity, r.reason, r.key) for r in rows.distinct().orderBy("reason", "key").collect()]

    def rows(self, phase: Phase) -> DataFrame:
        rows = export(self.spark, self.folder, phase.file, phase.schema)
        rows = phase.prepare(rows) if phase.prepare else rows
        # the first of a slug is the one that stands first in its file
        rows, repeated = L.first_of_slug(stored(rows.withColumn("_seq", F.monotonically_increasing_id()), "rows"), "slug", "_seq")
        self.warn(phase, repeated)
        for ref in phase.refs:
            # a kind may name its own kind, in this file
            have = _known(self.store, ref.target, "slug").select("_key")
            own = rows.select(F.col("slug").alias("_key")) if ref.target == phase.entity else have.limit(0)
            both = rows.join(have.unionByName(own).distinct().withColumn("_there", F.lit(True)), F.col(ref.column) == F.col("_key"), "left")
            lost = F.col(ref.column).isNotNull() & F.col("_there").isNull()
            if ref.missing == "abort":
                L.refuse(both.filter(lost).select(ref.column), f"{phase.entity}: no such {ref.column}")
            self.warn(phase, L.warnings(both.filter(lost), f"missing {ref.column}", F.col(ref.column)))
            kept = both.filter(~lost) if ref.missing == "row" else both.withColumn(ref.column, F.when(~lost, F.col(ref.column)))
            rows = stored(kept.drop("_key", "_there"), "rows")
        return rows

    def with_ids(self, phase: Phase, rows: DataFrame) -> DataFrame:
        have = register(self.store).filter(F.col("entity_type") == phase.entity).select("slug", "entity_id")
        both = stored(rows.join(have, "slug", "left"), "rows")
        new = both.filter("entity_id IS NULL").select("slug")
        self.report.created[phase.entity] = new.count()
        # ids are one sequence for all kinds, and an id is never given again
        top = self.store.read("claims").agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
        ids = C.numbered(new, ["slug"]).select("slug", (F.col("number") + top).alias("_new"))
        return stored(both.join(ids, "slug", "left").withColumn("entity_id", F.coalesce("entity_id", "_new")).drop("_new"), "rows")

    def relationship(self, phase: Phase, rows: DataFrame, many: Many) -> DataFrame:
        """(entity_id, field_name, claim_key, value) of one array column."""
        each = rows.select("entity_id", F.explode(many.column).alias("_m")).filter("_m IS NOT NULL")
        struct = len(many.parts) > 1
        parts = {}
        for i, (name, target) in enumerate(many.parts.items()):
            column = F.col(f"_m.{name}") if struct else F.col("_m")
            if target is None:
                each = each.withColumn(f"_p{i}", column)
            else:
                have = _known(self.store, target, many.by)
                if target == phase.entity:  # parents of the same file
                    own = rows.select(F.lower("name").alias("_key") if many.by != "slug" else F.col("slug").alias("_key"), F.col("slug").alias("_slug"))
                    have = have.unionByName(own).groupBy("_key").agg(F.min("_slug").alias("_slug"))
                key = F.lower(column) if many.by != "slug" else column
                each = each.join(have.withColumnRenamed("_slug", f"_p{i}"), key == F.col("_key"), "left").drop("_key")
                lost = each.filter(F.col(f"_p{i}").isNull()).select(column.alias("key"))
                if many.missing == "abort":
                    L.refuse(lost, f"{phase.entity}: unknown in {many.column}")
                self.warn(phase, L.warnings(lost, f"unknown in {many.column}", F.col("key")))
            parts[name.removesuffix("_slug")] = F.col(f"_p{i}")
        whole = each.dropna(subset=[f"_p{i}" for i in range(len(many.parts))])
        key, value = C.relationship_claim(many.namespace, parts)
        return whole.select("entity_id", F.lit(many.namespace).alias("field_name"), key.alias("claim_key"), value.alias("value")).distinct()

    def phase(self, phase: Phase) -> None:
        rows = self.rows(phase)
        if rows.isEmpty():  # nobody is spoken of, so nothing is said or taken back
            self.report.created[phase.entity], self.report.counts[phase.entity] = 0, {}
            return
        rows = self.with_ids(phase, rows)
        scalars = C.unpivoted(rows.withColumns({r.field: F.col(r.column) for r in phase.refs}), "entity_id", ["slug", *phase.fields, *[r.field for r in phase.refs]])
        said = scalars.select("entity_id", "field_name", F.col("field_name").alias("claim_key"), "value")
        owned = ["slug", *phase.fields, *[r.field for r in phase.refs]]
        for many in phase.many:
            said = said.unionByName(self.relationship(phase, rows, many))
            owned.append(many.namespace)
        if phase.aliases:
            said = said.unionByName(L.alias_claims(rows, phase.entity, "entity_id", phase.aliases).drop("entity_type"))
            owned.append("alias")
        pending = self.pending(said.withColumn("entity_type", F.lit(phase.entity)))
        if "description" in phase.fields:
            self.late.append(stored(pending.filter("field_name = 'description'"), "late"))
            pending = pending.filter("field_name <> 'description'")
            owned.remove("description")
        scope = rows.select(F.lit(phase.entity).alias("entity_type"), "entity_id")
        run = self.store.apply(pending, self.source, sweep=owned, scope=scope, name=phase.entity)
        self.report.counts[phase.entity] = run["counts"]

    def pending(self, said: DataFrame) -> DataFrame:
        blank = {"citation": F.lit(""), "needs_review": F.lit(False), "needs_review_notes": F.lit(""), "license_id": F.lit(None).cast("bigint"), "seq": F.lit(0).cast("bigint")}
        return said.withColumns(blank)

    def descriptions(self, routes: dict[str, int]) -> None:
        """Said last, by the source of the kind, or the load's own."""
        late = None
        for rows in self.late:
            late = rows if late is None else late.unionByName(rows)
        if late is None:
            return
        for source in sorted({*routes.values(), self.source}):
            kinds = [k for k, s in routes.items() if s == source]
            mine = late.filter(F.col("entity_type").isin(*kinds)) if source != self.source else late.filter(~F.col("entity_type").isin(*[k for k, s in routes.items() if s != source]))
            if not mine.isEmpty():
                run = self.store.apply(mine, source, sweep=["description"], name="description")
                self.report.counts[f"description by {source}"] = run["counts"]


def winners_of(store: ClaimStore, sources: DataFrame) -> DataFrame:
    return R.winners(R.effective(store.read("claims").withColumn("created_at", F.col("claim_id")), sources))


def direct_credits(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(series_id, person_id, role_id) of the credits that series carry: written as they are, not as claims. Credits whose person or role there is not
    are left out, equal ones are one."""
    each = rows.select("slug", F.inline("credit_refs"))
    ids = {k: tables[k].select(F.col("slug").alias(f"_{k}"), F.col("entity_id").alias(f"{k}_id")) for k in ("series", "person", "credit_role")}
    out = each.join(ids["series"], F.col("slug") == F.col("_series")).join(ids["person"], F.col("person_slug") == F.col("_person")).join(ids["credit_role"], F.col("role") == F.col("_credit_role"))
    return out.select("series_id", "person_id", F.col("credit_role_id").alias("role_id")).distinct()


def resolved(store: ClaimStore, sources: DataFrame, phases: tuple[Phase, ...] = PHASES) -> dict[str, DataFrame]:
    """Wide tables of all kinds and bridge tables of all relationships, from the winning claims."""
    won = stored(winners_of(store, sources), "won")
    have = register(store)
    before = {p.entity: have.filter(F.col("entity_type") == p.entity).select("entity_id", "slug") for p in phases}
    out = {k: stored(t, k) for k, t in R.resolve_all(won, specs(phases), before).items()}
    for p in phases:
        for m in p.many:
            names = {n.removesuffix("_slug"): t for n, t in m.parts.items()}
            rows = R.related(won.filter(F.col("entity_type") == p.entity), m.namespace, {n: "string" for n in names}).drop("entity_type")
            for name, target in names.items():
                if target:
                    dim = out[target].select(F.col("slug").alias(name), F.col("entity_id").alias(f"{name}_id"))
                    rows = rows.join(dim, name, "left")
            out[f"{p.entity}.{m.namespace}"] = rows
        if p.aliases:
            out[f"{p.entity}.alias"] = R.related(won.filter(F.col("entity_type") == p.entity), "alias", {"alias": "string", "display": "string"}).drop("entity_type")
    return out


def load(spark: SparkSession, folder: str, root: str, source_id: int, sources: DataFrame, phases: tuple[Phase, ...] = PHASES, routes: dict[str, int] | None = None, buckets: int = 64) -> Report:
    """Load ``folder`` as ``source_id`` into the store at ``root`` and write the resolved tables beside it. ``sources`` has source_id, priority, is_enabled; ``routes`` the source
    that says the descriptions of a kind of entity, where it isn't the load's own; ``buckets`` those of a new store."""
    store = ClaimStore(spark, f"{root.rstrip('/')}/store", buckets, files=1 if buckets < 16 else 4)
    run = _Run(spark, folder, store, source_id)
    with scratch():
        for phase in phases:
            run.phase(phase)
        run.descriptions(routes or {})
        tables = resolved(store, sources, phases)
        series = next((p for p in phases if p.entity == "series"), None)
        if series and {"person", "credit_role"} <= set(tables):
            tables["series.credit"] = direct_credits(run.rows(series), tables)
        for name, rows in tables.items():
            run.report.snapshots[name] = snapshot(rows, f"{root.rstrip('/')}/tables/{name}")
    return run.report
