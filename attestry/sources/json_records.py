"""Records of one large JSON document, read by many tasks.

A document that is one array, or has one under some keys, can't be cut at line ends. Here it is cut into byte ranges all the same. What a range can't know,
whether it begins within a string and how deep, follows from those before it: every range says how it changes that state, for either beginning, and the
answers are put together. Then each range gives the records that begin in it, and reads on to the end of its last one. Memory is a range's, or a record's
if that is larger.

Files are opened by pyarrow (local, HDFS, S3, GCS), in the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: quote, opening and closing brackets
_KIND = np.zeros(256, np.uint8)
_KIND[ord('"')] = 1
_KIND[[ord("{"), ord("[")]] = 2
_KIND[[ord("}"), ord("]")]] = 3
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in " \t\r\n,"]] = True
_SCHEMA = "file string, offset bigint, record string"


def opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _after_backslash(source: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands right before ``start``."""
    n, at = 0, start
    while at > 0:
        step = min(4096, at)
        data = source.read_at(step, at - step)
        bare = data.rstrip(b"\\")
        n += step - len(bare)
        if bare:
            break
        at -= step
    return n % 2 == 1


@dataclass
class Marks:
    """Brackets outside strings: places, whether they open, and depth behind them."""

    place: np.ndarray
    opens: np.ndarray
    depth: np.ndarray
    inside: bool


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of brackets and of quotes that are not escaped."""
    place = np.flatnonzero(_KIND[data])
    kind = _KIND[data[place]]
    quote = place[kind == 1]
    if len(quote):
        back = np.flatnonzero(data != 92)  # a run of backslashes begins behind one of these
        last = np.searchsorted(back, quote) - 1
        before = np.where(last >= 0, back[np.maximum(last, 0)], -1 - int(escaped))
        odd = (quote - 1 - before) % 2 == 1
        keep = np.ones(len(place), bool)
        keep[np.flatnonzero(kind == 1)[odd]] = False
        place, kind = place[keep], kind[keep]
    return place, kind


def marks(data: np.ndarray, inside: bool, depth: int, escaped: bool) -> Marks:
    place, kind = _quotes(data, escaped)
    quoted = (np.cumsum(kind == 1) + inside) % 2 == 1
    bracket = (kind > 1) & ~quoted
    opens = kind[bracket] == 2
    return Marks(place[bracket], opens, depth + np.cumsum(np.where(opens, 1, -1)), bool(quoted[-1]) if len(quoted) else inside)


def _change(source: pa.NativeFile, start: int, end: int) -> tuple[int, int, int]:
    """What a range does to the state: quotes it turns, and depth it adds if it begins outside or inside a string."""
    data, escaped = np.frombuffer(source.read_at(end - start, start), np.uint8), _after_backslash(source, start)
    out, within = marks(data, False, 0, escaped), marks(data, True, 0, escaped)
    return int(out.inside), *(int(m.depth[-1]) if len(m.depth) else 0 for m in (out, within))


def _key(source: pa.NativeFile, at: int) -> str | None:
    """The key of the value that begins at ``at``, None in an array or at the top."""
    step = 256
    while True:
        begin = max(0, at - step)
        text = source.read_at(at - begin, begin).rstrip(b" \t\r\n")
        if not text.endswith(b":"):
            return None if text or not begin else _key_again(source, at, step)
        text = text[:-1].rstrip(b" \t\r\n")
        quote = len(text) - 1
        while quote > 0:
            quote = text.rfind(b'"', 0, quote)
            slashes = len(text[:quote]) - len(text[:quote].rstrip(b"\\"))
            if quote >= 0 and slashes % 2 == 0 and (slashes < quote or begin == 0):
                return json.loads(text[quote:])
        if begin == 0:
            return None
        step *= 16


def _key_again(source: pa.NativeFile, at: int, step: int) -> str | None:
    return None if step > 1 << 24 else _key(source, at - step)  # nothing but blanks so far


@dataclass
class Range:
    file: str
    start: int
    end: int
    inside: bool = False
    depth: int = 0

    def read(self, source: pa.NativeFile) -> tuple[np.ndarray, Marks]:
        data = np.frombuffer(source.read_at(self.end - self.start, self.start), np.uint8)
        return data, marks(data, self.inside, self.depth, _after_backslash(source, self.start))


def _asked(spark: SparkSession, ranges: list[Range], schema: str, ask) -> list:
    """One row of answers a range, by as many tasks as there are ranges."""
    rows = spark.createDataFrame([(i, r.file, r.start, r.end, r.inside, r.depth) for i, r in enumerate(ranges)], "i int, file string, start bigint, end bigint, inside boolean, depth int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                r = Range(row["file"], row["start"], row["end"], row["inside"], row["depth"])
                with opened(r.file) as source:
                    out.append((row["i"], *ask(source, r)))
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int32()) for i, c in enumerate(zip(*out, strict=True))], ["i", *[p.split()[0] for p in schema.split(", ")]])

    got = rows.repartition(len(ranges), "i").mapInArrow(run, f"i int, {schema}").collect() if ranges else []
    return sorted(got, key=lambda g: g.i)


class DocumentError(ValueError):
    """A file is no JSON document, or lacks what is looked for."""


def _states(spark: SparkSession, file: str, size: int, chunk: int) -> list[Range]:
    ranges = [Range(file, a, min(a + chunk, size)) for a in range(0, size, chunk)]
    inside, depth = False, 0
    for r, change in zip(ranges, _asked(spark, ranges, "turns bigint, outside bigint, within bigint", lambda s, r: _change(s, r.start, r.end)), strict=True):
        r.inside, r.depth = inside, depth
        depth += change.within if inside else change.outside
        inside ^= bool(change.turns)
    if inside or depth:
        raise DocumentError(f"{file}: ends {'within a string' if inside else 'at depth ' + str(depth)}")
    return ranges


def _span(spark: SparkSession, ranges: list[Range], keys: list[str]) -> tuple[int, int, int]:
    """(begin, end, depth inside) of the array under ``keys``."""
    begin, end, depth = -1, ranges[-1].end if ranges else 0, 0
    for level, key in enumerate([None, *keys]):
        here = [r for r in ranges if r.end > begin and r.start < end]
        low, high = begin, end

        def find(source, r, level=level, key=key, low=low, high=high):
            _, m = r.read(source)
            place = m.place + r.start
            for at in place[m.opens & (m.depth == level + 1) & (place > low) & (place < high)].tolist():
                if key is None or _key(source, at) == key:
                    return (at,)
            return (-1,)

        found = [f.at for f in _asked(spark, here, "at bigint", find) if f.at >= 0]
        if not found:
            raise DocumentError(f"{ranges[0].file if ranges else 'file'}: no {'.'.join(keys[:level]) or 'document'}")
        begin = min(found)

        def close(source, r, level=level, low=begin):
            _, m = r.read(source)
            place = m.place + r.start
            hit = place[~m.opens & (m.depth == level) & (place > low)]
            return (int(hit[0]) if len(hit) else -1,)

        end = min(f.at for f in _asked(spark, [r for r in here if r.end > begin], "at bigint", close) if f.at >= 0)
        depth = level + 1
    return begin, end, depth


def _records(r: Range, begin: int, end: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Records that begin in a range, and stretches between records that are neither blanks nor commas."""
    with opened(r.file) as source:
        data, m = r.read(source)
        place = m.place + r.start
        own = m.opens & (m.depth == depth + 1) & (place > begin) & (place < end)
        shut = place[~m.opens & (m.depth == depth)]
        at = r.start if r.depth <= depth else None  # where the stretch between records begins
        if r.start <= begin < r.end:
            at = begin + 1
        elif begin >= r.end or end < r.start:
            return
        elif at is None:
            first = shut[shut > begin]
            at = int(first[0]) + 1 if len(first) else None
        for start in place[own].tolist():
            yield from _between(source, data, r, at, start)
            stop = np.searchsorted(shut, start)
            if stop < len(shut):
                last = int(shut[stop])
                yield start, data[start - r.start : last + 1 - r.start].tobytes()
                at = last + 1
            else:
                yield start, _to_the_end(source, r, data, start, m, depth)
                at = None
        if at is not None:
            yield from _between(source, data, r, at, min(end, r.end))


def _between(source: pa.NativeFile, data: np.ndarray, r: Range, at: int | None, to: int) -> Iterator[tuple[int, bytes]]:
    if at is None or at >= to:
        return
    odd = np.flatnonzero(~_BLANK[data[max(at, r.start) - r.start : to - r.start]])
    if len(odd):
        piece = data[max(at, r.start) - r.start : to - r.start].tobytes()
        yield at + int(odd[0]), piece[int(odd[0]) : int(odd[-1]) + 1]


def _to_the_end(source: pa.NativeFile, r: Range, data: np.ndarray, start: int, m: Marks, depth: int) -> bytes:
    parts, at, inside, now = [data[start - r.start :].tobytes()], r.end, m.inside, int(m.depth[-1])
    while piece := source.read_at(1 << 20, at):
        more = np.frombuffer(piece, np.uint8)
        n = marks(more, inside, now, _after_backslash(source, at))
        hit = np.flatnonzero(~n.opens & (n.depth == depth))
        if len(hit):
            parts.append(piece[: int(n.place[hit[0]]) + 1])
            break
        parts.append(piece)
        at, inside, now = at + len(piece), n.inside, int(n.depth[-1]) if len(n.depth) else now
    return b"".join(parts)


class _Part(InputPartition):
    def __init__(self, r: Range, span: tuple[int, int, int]):
        self.range, self.span = r, span


class _Reader(DataSourceReader):
    def __init__(self, plan: str):
        self.plan = json.loads(plan)

    def partitions(self) -> list[_Part]:
        return [_Part(Range(file, *r), tuple(span)) for file, span, ranges in self.plan for r in ranges]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.string())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.range.file] * len(rows)), pa.array([o for o, _ in rows]), pa.array([t.decode("utf-8", "replace") for _, t in rows])], schema=schema)

        for offset, text in _records(part.range, *part.span):
            rows.append((offset, text))
            size += len(text)
            if size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class JsonRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["plan"])


def records(spark: SparkSession, path: str, at: str = "", chunk: int = 8 << 20) -> DataFrame:
    """(file, offset, record) of the records of the array under the keys ``at`` (dots between them; the document itself if empty), of one file or of all that
    a pattern names. What stands in the array and is no object, is a record of its own, as it is."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    if not status:
        raise FileNotFoundError(path)
    plan = []
    for s in status:
        file, size = s.getPath().toString(), s.getLen()
        ranges = _states(spark, file, size, chunk)
        span = _span(spark, ranges, at.split(".") if at else [])
        plan.append((file, span, [(r.start, r.end, r.inside, r.depth) for r in ranges if r.end > span[0] and r.start < span[1]]))
    spark.dataSource.register(JsonRecords)
    return spark.read.format("json_records").option("plan", json.dumps(plan)).load()


def parsed(records_: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, corrupt ones as file, offset and record)."""
    full = spark_schema(records_.sparkSession, schema).add("_corrupt", "string")
    rows = records_.withColumn("_row", F.from_json("record", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row._corrupt").isNotNull() | ~F.col("record").startswith("{")
    good = rows.filter(~bad).select("_row.*").drop("_corrupt")
    return good, rows.filter(bad).select("file", "offset", "record")


def spark_schema(spark: SparkSession, schema: str):
    return spark.createDataFrame([], schema).schema
