"""Registries that drive schemas, casts, pivots and checks: fields of entities, relationships, and constraints derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    default: object = None
    #: keeps its former value when nobody claims it (unique fields, required references)
    preserve: bool = False
    unique: bool = False
    #: entity that a claimed key names, and the column it is looked up by
    target: str | None = None
    lookup: str = "slug"
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class EntitySpec:
    name: str
    fields: tuple[FieldSpec, ...]
    #: claims of unknown fields are kept as a map
    extra: bool = False

    def field(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{f.name}` {f.type}" for f in self.fields))

    def constraints(self) -> dict[str, dict[str, float | None]]:
        """Bounds of the fields that have some, for forms and checks."""
        return {f.name: {"min": f.least, "max": f.most, "step": 1 if f.type in ("int", "bigint") else None} for f in self.fields if f.least is not None or f.most is not None}


@dataclass(frozen=True)
class RelationshipSpec:
    namespace: str
    subjects: tuple[str, ...]
    #: identity part and its JSON type: string, int, boolean
    identity: dict[str, str]
    #: further keys of the value
    payload: dict[str, str] = field(default_factory=dict)
    target: str | None = None


def coerced(value: Column, spec: FieldSpec) -> Column:
    """A claimed string as the field's type: blank and unreadable values are null (the empty string stays one for strings)."""
    if spec.type == "string":
        return value
    bare = F.nullif(F.trim(value), F.lit(""))
    if spec.type == "boolean":
        return F.when(bare.isNotNull(), F.lower(bare).isin("true", "1", "yes"))
    if spec.type in ("int", "bigint"):
        return bare.try_cast("double").try_cast(spec.type)
    return bare.try_cast(spec.type)


def violation(spec: FieldSpec, value: Column) -> Column:
    """Why a scalar claim is refused, null if it isn't: blank, type, bounds, choices, form of slugs."""
    typed = coerced(value, spec)
    out = F.when(value.isNotNull() & (value != "") & (F.trim(value) == ""), "blank")
    out = out.when(value.isNotNull() & (value != "") & typed.isNull(), "type")
    if spec.least is not None:
        out = out.when(typed < spec.least, "below minimum")
    if spec.most is not None:
        out = out.when(typed > spec.most, "above maximum")
    if spec.choices:
        out = out.when(~typed.isin(*spec.choices), "choice")
    if spec.name == "slug":
        out = out.when(~value.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "slug form")
    return out
