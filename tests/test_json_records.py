"""One JSON document read by byte ranges, against json.loads, for ranges of every size."""

from __future__ import annotations

import json
import random

import pytest

from attestry.sources import json_records as J
from attestry.sources import readers as R

TEXTS = ["", "plain", 'quote " in', "\\", "\\\\", 'ends in \\"', "{[", "}]", '"},{"', "é漢字🙂", "a\nb", "\\u0022", ": ,", "[{}]"]


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 4:
        return [rng.choice(TEXTS), rng.randrange(100), None, True][kind]
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def documents(rng, n):
    rows = [{"id": i, rng.choice(TEXTS): value(rng), "x": value(rng)} for i in range(n)]
    return rows, {"Data": rows, "Other": [{"id": -1}], "a": {"Data": [{"id": -2}], "b\"\\": {"rows": rows}}, "empty": []}


def of_ranges(file, data, at, chunk):
    """The records, with the ranges' answers put together here instead of by Spark."""
    class Here:
        @staticmethod
        def ask(_, ranges, schema, ask):
            names = [p.split()[0] for p in schema.split(", ")]
            with J.opened(file) as source:
                return [type("Row", (), dict(zip(names, ask(source, r), strict=True))) for r in ranges]

    real, J._asked = J._asked, Here.ask
    try:
        ranges = J._states(None, file, len(data), chunk)
        span = J._span(None, ranges, at)
    finally:
        J._asked = real
    return [(o, t) for r in ranges if r.end > span[0] and r.start < span[1] for o, t in J._records(r, *span)]


@pytest.mark.parametrize("seed", range(6))
def test_every_range_size(tmp_path, seed):
    rng = random.Random(seed)
    rows, whole = documents(rng, 25)
    for indent in (None, 1):
        for at, doc in (([], rows), (["Data"], whole), (["a", 'b"\\', "rows"], whole), (["empty"], whole)):
            data = json.dumps(doc, indent=indent, ensure_ascii=bool(seed % 2)).encode()
            file = tmp_path / "x.json"
            file.write_bytes(data)
            for chunk in (1, 2, 3, 7, 64, 1000, 10**6) if len(data) < 3000 else (5, 17, 255, 10**6):
                got = of_ranges(str(file), data, at, chunk)
                want = [] if at == ["empty"] else rows
                assert [json.loads(t) for _, t in got] == want, (at, chunk)
                assert all(data[o : o + len(t)] == t for o, t in got)


def test_what_is_no_record(tmp_path):
    file = tmp_path / "x.json"
    data = b'[ {"a": 1}, 17 , {"a": 2} "x{" , {"a": 3}, null]'
    file.write_bytes(data)
    for chunk in (4, 9, 1000):
        got = b"|".join(t for _, t in of_ranges(str(file), data, [], chunk))
        assert [t for t in (b'{"a": 1}', b'{"a": 2}', b'{"a": 3}') if t in got] and got.replace(b"|", b"").replace(b" ", b"").replace(b",", b"") == b'{"a":1}17{"a":2}"x{"{"a":3}null'


def test_by_spark(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"IpdbId": i, "Title": rng.choice(TEXTS), "Players": rng.randrange(5), "ImageFiles": [{"Url": "u", "Name": rng.choice(TEXTS)}]} for i in range(3000)]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"LastRefreshDateUtc": "x", "Data": rows}, indent=1))
    got = J.records(spark, f"file://{path}", "Data", chunk=1 << 14)
    assert got.rdd.getNumPartitions() > 20
    by_task = [n for n in got.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()]
    assert sum(by_task) == 3000 and max(by_task) < 200
    split = R.wrapped_machines(spark, f"file://{path}", chunk=1 << 14)
    whole = R.wrapped_machines(spark, f"file://{path}")
    assert split.schema == whole.schema and sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_corrupt_and_drifted(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('[{"opdb_id": "a"}, {"opdb_id": }, 5, {"opdb_id": "b", "ipdb_id": "x"}]')
    good, bad = J.parsed(J.records(spark, f"file://{path}", chunk=8), "opdb_id string, ipdb_id int")
    assert [r.opdb_id for r in good.collect()] == ["a"]
    assert sorted(r.record for r in bad.collect()) == ["5", '{"opdb_id": "b", "ipdb_id": "x"}', '{"opdb_id": }']
    with pytest.raises(R.DriftError):
        R.machine_array(spark, f"file://{path}", chunk=8)
    path.write_text('{"Data": [{"Title": "no id"}]}')
    with pytest.raises(R.DriftError):
        R.wrapped_machines(spark, f"file://{path}", chunk=8)
    for broken in ('{"Data": [{"a": 1}', '{"Data": [{"a": "1}]}'):
        path.write_text(broken)
        with pytest.raises(J.DocumentError):
            J.records(spark, f"file://{path}", "Data", chunk=8)
    path.write_text('{"Other": []}')
    with pytest.raises(J.DocumentError):
        J.records(spark, f"file://{path}", "Data", chunk=8)
    with pytest.raises(FileNotFoundError):
        J.records(spark, f"file://{tmp_path}/none.json")
