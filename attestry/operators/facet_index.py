"""A stored index for faceted search: a bitmap for each value of each dimension, so that filters and counts don't read documents.

Scalars and arrays have a bitmap a value. Numbers that are compared (ranges, least values) are cut into bins at quantiles: bins beyond the bound are whole
bitmaps, of the one bin that the bound falls into the numbers themselves are read. Text is searched in its columns alone. A dimension's files are apart, and a
large dimension's values are dealt over parts, so that what is read follows the values that are named. A value takes 4 KB of bits for each 32,768 documents
before compression: the index is for dimensions with some thousand values, not for keys.

Null values are in no set; a document without an array, or with an empty one, has none; arrays count a value once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stored
from .bitmaps import intersection, positions, sets, sizes, union
from .facets import Dimension, FilterState


_SCHEMAS = {
    "all": "bucket bigint, bits binary", "values": "value string, bucket bigint, bits binary, dimension string, part int", "cuts": "dimension string, bin int, low double",
    "numbers": "number bigint, value double, dimension string, bin int", "bins": "bucket bigint, bits binary, dimension string, bin int",
}


class FacetIndex:
    def __init__(self, spark: SparkSession, root: str, dimensions: list[Dimension], parts: int = 16):
        self.spark, self.root, self.dimensions, self.parts = spark, root.rstrip("/"), dimensions, parts
        self.by = {d.name: d for d in dimensions}

    def part(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.parts)).cast("int")

    def compared(self) -> dict[str, Column]:
        """Ordered columns by name: the ends of ranges, a missing end being the other one, and the numbers that have a least value."""
        out = {}
        for d in self.dimensions:
            if d.kind == "range":
                first, last = F.col(d.columns[0]), F.col(d.columns[1])
                out |= {f"{d.name}.first": F.coalesce(first, last), f"{d.name}.last": F.coalesce(last, first)}
            elif d.kind == "atleast":
                out[d.name] = F.col(d.column)
        return {n: c.cast("double") for n, c in out.items()}

    def build(self, docs: DataFrame, key: str, bins: int = 32) -> FacetIndex:
        """Write the index of ``docs``, whose ``key`` is unique."""
        ids = positions(docs, key).withColumnRenamed("member", key)
        texts = sorted({c for d in self.dimensions if d.kind == "text" for c in d.columns})
        rows = stored(docs.join(ids, key), "facets")  # every part of the index is made of them
        rows.select(F.col(key).alias("key"), "number", *[F.col(c).alias(f"text_{c}") for c in texts]).write.parquet(f"{self.root}/ids")
        numbers = self.spark.read.parquet(f"{self.root}/ids").select("key", "number")
        sets(numbers, []).write.parquet(f"{self.root}/all")

        def named(name: str):
            return lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value"))

        pairs = []
        for d in self.dimensions:
            if d.kind in ("scalar", "any", "all"):
                values = F.col(d.column) if d.kind != "scalar" else F.array(d.column)
                pairs.append(F.transform(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), named(d.name)))
        spread = rows.select("number", F.explode(F.flatten(F.array(*pairs))).alias("p")).select("number", "p.*").filter("value IS NOT NULL")
        values = sets(spread, ["dimension", "value"]).withColumn("part", self.part(F.col("value")))
        values.repartition("dimension", "part").write.partitionBy("dimension", "part").parquet(f"{self.root}/values")

        columns = self.compared()
        if columns:
            said = rows.select("number", *[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
            cuts = said.select(*[F.percentile_approx(f"c{i}", [j / bins for j in range(1, bins)], 1000).alias(f"c{i}") for i in range(len(columns))]).first()
            lows = [(n, i + 1, low) for (n, cut) in zip(columns, cuts, strict=True) for i, low in enumerate(sorted(set(cut or [])))]
            self.spark.createDataFrame(lows, "dimension string, bin int, low double").coalesce(1).write.parquet(f"{self.root}/cuts")
            of = {n: [low for m, _, low in lows if m == n] for n in columns}
            each = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"c{i}").alias("value"), self.bin(F.col(f"c{i}"), of[n]).alias("bin")) for i, n in enumerate(columns)])
            flat = said.select("number", F.explode(each).alias("e")).select("number", "e.*").filter("value IS NOT NULL")
            flat.repartition("dimension", "bin").write.partitionBy("dimension", "bin").parquet(f"{self.root}/numbers")
            sets(flat, ["dimension", "bin"]).repartition("dimension", "bin").write.partitionBy("dimension", "bin").parquet(f"{self.root}/bins")
        return self

    @staticmethod
    def bin(value: Column, lows: list[float]) -> Column:
        """How many cuts are at or below the value."""
        return sum(((value >= low).cast("int") for low in lows), F.lit(0))

    def _table(self, name: str) -> DataFrame:
        # types are told, as names of folders could be read as numbers and an empty index has no files
        reader = self.spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else self.spark.read
        return reader.parquet(f"{self.root}/{name}")

    def _values(self, name: str, chosen: list | None = None) -> DataFrame:
        """(value, bucket, bits) of a dimension, or of some of its values."""
        rows = self._table("values").filter(F.col("dimension") == name)
        if chosen is not None:
            given = [str(x) for x in chosen]
            parts = {r.p for r in self.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in given])).alias("v")).select(self.part(F.col("v")).alias("p")).collect()}
            rows = rows.filter(F.col("part").isin(*parts)).filter(F.col("value").isin(*given))
        return rows.select("value", "bucket", "bits")

    def _beyond(self, name: str, bound: float, up: bool) -> DataFrame:
        """(bucket, bits) of documents whose number is at least the bound, or at most."""
        lows = [r.low for r in self._table("cuts").filter(F.col("dimension") == name).orderBy("low").collect()]
        edge = sum(low <= bound for low in lows)
        whole = self._table("bins").filter(F.col("dimension") == name).filter(F.col("bin") > edge if up else F.col("bin") < edge).select("bucket", "bits")
        near = self._table("numbers").filter((F.col("dimension") == name) & (F.col("bin") == edge)).filter(F.col("value") >= bound if up else F.col("value") <= bound)
        return union(whole.unionByName(sets(near, [])), [])

    def one(self, name: str, chosen) -> DataFrame:
        """(bucket, bits) of the documents that pass one dimension's filter."""
        d = self.by[name]
        if d.kind == "scalar" or d.kind == "any":
            return union(self._values(name, list(chosen) if isinstance(chosen, (list, tuple)) else [chosen]).drop("value"), [])
        if d.kind == "all":
            wanted = sorted({str(x) for x in chosen})
            return intersection(self._values(name, wanted), [], len(wanted), "value") if wanted else self._table("all")
        if d.kind == "atleast":
            return self._beyond(name, float(chosen), True)
        if d.kind == "range":
            low, high = chosen
            ends = ([self._beyond(f"{name}.last", float(low), True)] if low is not None else []) + ([self._beyond(f"{name}.first", float(high), False)] if high is not None else [])
            known = self._beyond(f"{name}.last", float("-inf"), True) if not ends else None
            return known if known is not None else self._shared(ends)
        return sets(self._table("ids").filter(Dimension(name, "", "text", tuple(f"text_{c}" for c in d.columns)).test(chosen)), [])

    def _shared(self, filters: list[DataFrame]) -> DataFrame:
        if not filters:
            return self._table("all")
        rows = None
        for i, f in enumerate(filters):
            f = f.select("bucket", "bits", F.lit(i).alias("label"))
            rows = f if rows is None else rows.unionByName(f)
        return intersection(rows, [], len(filters))

    def found(self, state: FilterState) -> DataFrame:
        """(bucket, bits) of the documents that pass all filters."""
        return self._shared([self.one(n, v) for n, v in state.chosen.items()])

    def count(self, state: FilterState) -> int:
        return sizes(self.found(state).withColumn("_", F.lit(0)), ["_"], "n").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def keys(self, state: FilterState) -> DataFrame:
        """The keys of the documents that pass: the one place where a row a document is read."""
        ids = self._table("ids").select("key", "number").withColumns({"bucket": F.bitmap_bucket_number("number"), "bit": F.bitmap_bit_position("number")})
        byte = F.expr("conv(hex(substring(bits, cast(bit div 8 AS int) + 1, 1)), 16, 10)").cast("int")
        return ids.join(self.found(state), "bucket").filter(F.call_function("getbit", byte, (F.col("bit") % 8).cast("int")) == 1).select("key")

    def counts(self, state: FilterState, counted: list[str]) -> DataFrame:
        """(dimension, value, n), as :func:`facets.counts`: each counted dimension under all filters but its own. Values that no document is left of don't appear."""
        out = None
        filters = {n: self.one(n, v) for n, v in state.chosen.items()}
        for name in counted:
            base = self._shared([f for n, f in filters.items() if n != name]).withColumnRenamed("bits", "_base")
            both = self._values(name).join(base, "bucket").select("value", "bucket", F.explode(F.array("bits", "_base")).alias("bits"))
            left = both.groupBy("value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
            rows = sizes(left, ["value"], "n").filter("n > 0").select(F.lit(name).alias("dimension"), "value", "n")
            out = rows if out is None else out.unionByName(rows)
        return out
