"""Resolution: the winning claim of each key, wide typed rows, relationships, licences, unique conflicts, primary media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.specs import EntitySpec, coerced
from ._shared import stored
from .claims import exists_flag

KEY = ("entity_type", "entity_id", "claim_key")


def effective(claims: DataFrame, sources: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Active claims with their priority: the source's, else the user's, else 0. Claims of disabled sources are left out, claims of users stay."""
    src = sources.select("source_id", F.col("priority").alias("_source_priority"), "is_enabled")
    out = claims.filter("is_active").join(src, "source_id", "left").filter(F.col("source_id").isNull() | F.coalesce("is_enabled", F.lit(True)))
    if users is None:
        return out.withColumn("priority", F.coalesce("_source_priority", F.lit(0))).drop("_source_priority", "is_enabled")
    out = out.join(users.select("user_id", F.col("priority").alias("_user_priority")), "user_id", "left")
    priority = F.when(F.col("source_id").isNotNull(), F.col("_source_priority")).when(F.col("user_id").isNotNull(), F.col("_user_priority")).otherwise(0)
    return out.withColumn("priority", priority).drop("_source_priority", "_user_priority", "is_enabled")


def order_of() -> Column:
    """Priority, then the later claim, then the larger id."""
    return F.struct("priority", "created_at", "claim_id")


def winners(claims: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The winning row of each key. An aggregate, so that losers are dropped before the shuffle."""
    rest = [c for c in claims.columns if c not in keys]
    best = claims.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_of()).alias("row"))
    return best.select(*keys, *[F.col(f"row.{c}") for c in rest])


def flagged(claims: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """All rows with is_winner."""
    w = W.partitionBy(*keys).orderBy(F.desc("priority"), F.desc("created_at"), F.desc("claim_id"))
    return claims.withColumn("is_winner", F.row_number().over(w) == 1)


def wide(won: DataFrame, spec: EntitySpec, entities: DataFrame | None = None) -> DataFrame:
    """Winners to one typed row an entity. Unclaimed fields take their default, or keep the value in ``entities`` where they preserve; all
    rows of ``entities`` appear. Other claims are gathered in extra (a map) if the entity has one."""
    won = won.filter(F.col("entity_type") == spec.name)
    names = [f.name for f in spec.fields]
    one = [F.max(F.when(F.col("claim_key") == n, F.col("value"))).alias(n) for n in names]
    said = [F.max((F.col("claim_key") == n).cast("int")).alias(f"_has_{n}") for n in names]
    more = [F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("claim_key").isin(*names) & ~F.col("claim_key").contains("|"), F.struct("claim_key", "value"))))).alias("extra")] if spec.extra else []
    rows = won.groupBy("entity_id").agg(*one, *said, *more)
    if entities is not None:
        before = entities.select("entity_id", *[F.col(f.name).alias(f"_was_{f.name}") for f in spec.fields if f.preserve])
        rows = before.join(rows, "entity_id", "left")

    def final(f) -> Column:
        value = coerced(F.col(f.name), f)
        default = F.lit(f.default).cast(f.type)
        rest = F.col(f"_was_{f.name}") if f.preserve and entities is not None else default
        return F.when(F.col(f"_has_{f.name}") == 1, F.coalesce(value, default)).otherwise(rest).alias(f.name)

    return rows.select("entity_id", *[final(f) for f in spec.fields], *(["extra"] if spec.extra else []))


def with_targets(rows: DataFrame, spec: EntitySpec, tables: dict[str, DataFrame]) -> DataFrame:
    """Claimed keys of other entities to their ids (``<field>_id``), null where there is no such entity."""
    for f in spec.fields:
        if f.target in tables:
            dim = tables[f.target].select(F.col(f.lookup).alias(f.name), F.col("entity_id").alias(f"{f.name}_id")).dropDuplicates([f.name])
            rows = rows.join(dim, f.name, "left")
    return rows


def conflicts(rows: DataFrame, before: DataFrame, column: str) -> DataFrame:
    """Of entities with the same new value of a unique column, all but one lose: who had it before keeps it, else the smallest id.
    Losers (entity_id, value) go back to what they had."""
    had = before.select("entity_id", F.col(column).alias("_had"))
    w = W.partitionBy(column).orderBy(F.desc(F.col(column).eqNullSafe(F.col("_had"))), "entity_id")
    placed = rows.join(had, "entity_id", "left").filter(F.col(column).isNotNull()).withColumn("_place", F.row_number().over(w))
    return placed.filter("_place > 1").select("entity_id", F.col(column).alias("value"), F.col("_had").alias("keeps"))


def settled(rows: DataFrame, before: DataFrame, column: str, nullable: bool = False) -> DataFrame:
    """(entity_id, column, outcome): the column made unique. Blank values never clash.

    Nullable: of those with equal values the smallest id keeps it, the others are ``cleared``. Otherwise who had the value before keeps it, else the smallest
    id; losers go back to what they had (``reverted``; ``cleared`` if they had nothing), which may take the value from someone who took theirs, and so on.
    Each entity has at most one that it displaces by going back, so whole chains are found by doubling steps, in rounds that follow the logarithm of the
    longest. ``rows`` has all entities; values ``before`` must be unique."""
    had = before.select("entity_id", F.col(column).alias("_had"))
    new = rows.select("entity_id", F.col(column).alias("_new")).join(had, "entity_id", "left")
    new = stored(new.withColumns({c: F.when(F.col(c).cast("string") != "", F.col(c)) for c in ("_new", "_had")}), "settled")
    mine = F.coalesce(F.col("_new") == F.col("_had"), F.lit(False))
    rank = F.struct(F.lit(0) if nullable else F.when(mine, 0).otherwise(1), F.col("entity_id"))
    owners = new.filter("_new IS NOT NULL").groupBy("_new").agg(F.min_by(F.struct("entity_id", mine.alias("mine")), rank).alias("owner")).select(F.col("_new").alias("_value"), "owner.entity_id", "owner.mine")
    lost = new.filter("_new IS NOT NULL").join(owners.select("entity_id"), "entity_id", "left_anti").select("entity_id")
    if not nullable:
        # going back, an entity displaces the one that holds its old value now
        jumps = new.filter(~mine & F.col("_had").isNotNull()).select("entity_id", F.col("_had").alias("_value")).join(owners.filter("NOT mine").withColumnRenamed("entity_id", "next"), "_value").filter("next <> entity_id")
        jumps, lost = stored(jumps.select("entity_id", "next"), "jumps"), stored(lost, "lost")
        while True:
            more = lost.join(jumps, "entity_id").select(F.col("next").alias("entity_id")).distinct()
            more = stored(more.join(lost, "entity_id", "left_anti"), "lost")
            if more.isEmpty():
                break
            lost = stored(lost.unionByName(more), "lost")
            further = jumps.select(F.col("entity_id").alias("next"), F.col("next").alias("_next"))
            jumps = stored(jumps.join(further, "next").select("entity_id", F.col("_next").alias("next")), "jumps")
    out = new.join(lost.withColumn("_lost", F.lit(True)), "entity_id", "left")
    back = F.lit(None) if nullable else F.col("_had")
    final = F.when(F.col("_lost"), back).otherwise(F.col("_new"))
    outcome = F.when(F.col("_lost").isNull(), "kept").when(back.isNull(), "cleared").otherwise("reverted")
    return out.select("entity_id", final.alias(column), outcome.alias("outcome"))


def related(won: DataFrame, namespace: str, parts: dict[str, str]) -> DataFrame:
    """Existing relationships of winners: entity_id and the parts of the value, typed."""
    rows = won.filter((F.col("field_name") == namespace) & exists_flag(F.col("value")))
    return rows.select("entity_type", "entity_id", *[F.get_json_object("value", f"$.{k}").try_cast(t).alias(k) for k, t in parts.items()])


def related_any(claims: DataFrame, namespace: str, parts: dict[str, str]) -> DataFrame:
    """Relationships that anyone says to exist, whatever others say: no winner is picked."""
    return related(claims, namespace, parts).distinct()


def materialization(desired: DataFrame, existing: DataFrame, keys: list[str], payload: list[str] | None = None) -> DataFrame:
    """What to do to a bridge table: action create, update, delete or keep for each key."""
    payload = payload or []
    new = desired.select(*keys, *[F.col(p).alias(f"_new_{p}") for p in payload], F.lit(1).alias("_d"))
    old = existing.select(*keys, *[F.col(p).alias(f"_old_{p}") for p in payload], F.lit(1).alias("_e"))
    same = reduce(lambda a, b: a & b, [F.col(f"_new_{p}").eqNullSafe(F.col(f"_old_{p}")) for p in payload], F.lit(True))
    action = F.when(F.col("_e").isNull(), "create").when(F.col("_d").isNull(), "delete").when(same, "keep").otherwise("update")
    both = new.join(old, keys, "full_outer").withColumn("action", action)
    return both.select(*keys, *[F.when(F.col("_d").isNotNull(), F.col(f"_new_{p}")).otherwise(F.col(f"_old_{p}")).alias(p) for p in payload], "action")


def effective_license(claims: DataFrame, field_licenses: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds effective_license_id: the claim's, else the one of (source, field), else the source's, else null."""
    per_field = field_licenses.select("source_id", "field_name", F.col("license_id").alias("_field_license"))
    per_source = sources.select("source_id", F.col("default_license_id").alias("_source_license"))
    out = claims.join(per_field, ["source_id", "field_name"], "left").join(per_source, "source_id", "left")
    return out.withColumn("effective_license_id", F.coalesce("license_id", "_field_license", "_source_license")).drop("_field_license", "_source_license")


def displayable(rank: Column, least: int, unknown: int = 5) -> Column:
    """Whether a licence of this permissiveness may be shown under a policy's least rank."""
    return F.coalesce(rank, F.lit(unknown)) >= F.lit(least)


def with_field_licenses(rows: DataFrame, won: DataFrame, licenses: DataFrame, fields: tuple[str, ...], extra: str = "extra") -> DataFrame:
    """Rows whose map ``extra`` also tells the licence of some of its entries: ``<field>.__license`` and ``<field>.__permissiveness_rank`` of the winning claim's effective licence, so
    that a page needs no claim to know whether it may show an image. ``won`` has effective_license_id, ``licenses`` license_id, slug, rank."""
    kept = licenses.select(F.col("license_id").alias("effective_license_id"), F.col("slug").alias("_slug"), F.col("rank").cast("string").alias("_rank"))
    told = won.filter(F.col("claim_key").isin(*fields)).join(kept, "effective_license_id")
    parts = (("__license", "_slug"), ("__permissiveness_rank", "_rank"))
    entries = F.array(*[F.struct(F.concat("claim_key", F.lit(f".{n}")).alias("key"), F.col(c).alias("value")) for n, c in parts])
    per = told.select("entity_id", F.explode(entries).alias("e")).filter("e.value IS NOT NULL").groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("_more"))
    none = F.expr("cast(map() AS map<string,string>)")
    return rows.join(per, "entity_id", "left").withColumn(extra, F.map_concat(F.coalesce(extra, none), F.coalesce("_more", none))).drop("_more")


def primary_media(media: DataFrame) -> DataFrame:
    """At most one primary an (entity, category): the highest priority of those claimed, else the oldest is promoted."""
    part = W.partitionBy("entity_type", "entity_id", "category")
    best = F.row_number().over(part.orderBy(F.desc(F.col("is_primary").cast("int")), F.when(F.col("is_primary"), -F.col("priority")), F.col("created_at"), F.col("asset_id")))
    return media.withColumn("is_primary", best == 1)


def unclaimed_check(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Cross-field rules (name to SQL condition): rows that break one, with its name."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", F.explode(broken))


def aliases_of(won: DataFrame, existing: DataFrame, namespace: str = "alias") -> DataFrame:
    """Alias table from winners: one row an (entity, lower-case alias) with the spelling to show; action create, update (other spelling), delete or keep."""
    said = related(won, namespace, {"alias": "string", "display": "string"}).select("entity_id", "alias", F.coalesce("display", "alias").alias("display"))
    return materialization(said, existing.select("entity_id", F.lower("display").alias("alias"), "display"), ["entity_id", "alias"], ["display"])


def in_dependency_order(specs: list[EntitySpec]) -> list[EntitySpec]:
    """Entities after those that their fields name; ties by name. A circle of entities is an error."""
    left, done, out = {s.name: s for s in specs}, set(), []
    while left:
        ready = sorted(n for n, s in left.items() if all(f.target in (None, n) or f.target in done or f.target not in left for f in s.fields))
        if not ready:
            raise ValueError(f"entities depend on one another: {sorted(left)}")
        for n in ready:
            out.append(left.pop(n))
            done.add(n)
    return out


def resolve_all(won: DataFrame, specs: list[EntitySpec], before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All entities' wide tables, each with the ids of those it names (``<field>_id``): those that others name come first. ``before`` has the
    tables as they were; one that is not there starts from its claims."""
    before, out = before or {}, {}
    for spec in in_dependency_order(specs):
        rows = wide(won, spec, before.get(spec.name))
        names = {f.target for f in spec.fields if f.target}
        out[spec.name] = with_targets(rows, spec, {n: t for n, t in {**before, **out}.items() if n in names})
    return out


def resolve_touched(won: DataFrame, specs: list[EntitySpec], touched: DataFrame, before: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only the entities in ``touched`` (entity_type, entity_id, field_name), and of them only kinds with a field that was touched; other rows stay."""
    out = {}
    for spec in specs:
        fields = [f.name for f in spec.fields]
        hit = touched.filter((F.col("entity_type") == spec.name) & (F.col("field_name").isin(*fields) | F.lit(spec.extra))).select("entity_id").distinct()
        was = before[spec.name]
        rows = wide(won.join(hit, "entity_id", "left_semi"), spec, was.join(hit, "entity_id", "left_semi"))
        out[spec.name] = was.join(hit, "entity_id", "left_anti").unionByName(rows.select(*was.columns))
    return out
