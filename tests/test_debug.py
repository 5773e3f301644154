import random
import tracemalloc

import pyarrow as pa
import pytest

from lithic.operators import debug as D
from lithic.plans import program_bindings as P
from lithic.sources import bundles, debug
from lithic.sources import image as I

BODY = I.encode_body([(0, [0])], {0: ("Ret", ["Reg8"])})
STREAMS = {0: [(0, 1, 1), (4, 3, 9), (9, 2, 0)], 2: [(0, 70000, 5)]}
SCOPES = [(None, 0, []), (0, 1, ["alpha", "beta", "größe"]), (1, 2, ["alpha", ""])]


def sample(version, **more):
    made = debug.build(version, STREAMS, SCOPES, {0: 1, 1: 2}, {4: "callee", 9: "alpha"})
    return I.build(version, ["f"], [{"body": BODY, "name_id": 0} for _ in range(4)], handlers={0: [(0, 2, 2)]}, debug=made, **more)


def read(data):
    return debug.read(data, I.read(data))


@pytest.mark.parametrize("version", [60, 84, 96, 98, 99])
def test_round_trip(version):
    found, old = read(sample(version)), version <= 96
    assert found.status == "present"
    assert [x[:5] for x in found.locations] == [(f, k, *p) for f, points in STREAMS.items() for k, p in enumerate(points)]
    assert {s for *_, s in found.locations} == ({None, found.scopes[1][0]} if old else {None})
    if not old:
        assert not found.scopes and not found.callees and not found.function_scopes
        return
    at = [s[0] for s in found.scopes]
    assert [(s[1], s[2], s[3]) for s in found.scopes] == [(None, 0, []), (at[0], 1, ["alpha", "beta", "größe"]), (at[1], 2, ["alpha", ""])]
    assert found.function_scopes == [(0, at[1]), (1, at[2])] and found.callees == {4: "callee", 9: "alpha"}


def test_numbers():
    values = [0, -1, 63, 64, -64, -65, 2**31, -(2**40), 2**63 - 1]
    data = b"".join(map(debug.encode_number, values))
    assert [v for v, _ in debug.numbers(data)] == values
    assert list(debug.numbers(b"\x80" * 11 + b"\x00")) == [] and [v for v, _ in debug.numbers(b"\x05\x80")] == [5]


def test_entries_without_location_move_the_address_only():
    n = debug.encode_number
    head = n(0) + n(10) + n(2) + n(0)
    stream = head + n(3) + n(0) + n(4) + n(5 << 3 | 7) + n(-9) + n(1) + n(1) + n(-1) + n(99)
    assert debug.locations(stream, 0, False) == [(0, 10, 2, None), (7, 15, 0, None)]
    assert debug.locations(head[:2], 0, False) == [] and debug.locations(stream[:8], 0, False) == [(0, 10, 2, None)]
    marked = n(0) + n(10) + n(2) + n(3) + n(2 << 1 | 1) + n(1) + n(6) + n(0) + n(5) + n(-1)
    assert debug.locations(marked, 0, True) == [(0, 10, 2, None), (3, 12, 3, 6)]


def test_why_there_is_none():
    plain = I.build(96, ["f"], [{"body": BODY}])
    assert read(plain).status == "absent"
    good, image = sample(96), I.read(sample(96))
    for value, status in ((len(good), "offset_out_of_range"), (len(good) - 8, "parse_failed"), (128, "header_out_of_range"), (0xFFFFFFFF, "absent")):
        image.header["debug_info_offset"] = value
        assert debug.read(good, image).status == status
    image.version = 97
    image.header["debug_info_offset"] = 200
    assert debug.read(good, image).status == "unsupported_version"


def test_damage_never_raises():
    good, some = sample(96), random.Random(1)
    start = I.read(good).header["debug_info_offset"]
    for _ in range(500):
        bad = bytearray(good)
        for _ in range(3):
            bad[some.randrange(start, len(bad))] = some.randrange(256)
        read(bytes(bad))


def test_tables(spark):
    files = spark.createDataFrame([("old", sample(96)), ("new", sample(99)), ("none", I.build(96, ["f"], [{"body": BODY}])), ("junk", b"junk")], "path string, content binary")
    facts = {k: bundles.facts(files, k) for k in ("debug_status", "debug_locations", "function_scopes", "scopes", "callees", "functions")}
    assert {tuple(r) for r in facts["debug_status"].collect()} == {("old", "present"), ("new", "present"), ("none", "absent")}
    named = {tuple(r) for r in D.variable_map(facts["function_scopes"], facts["scopes"]).collect()}
    assert named == {("old", 0, 0, "alpha"), ("old", 0, 1, "beta"), ("old", 0, 2, "größe"), ("old", 1, 0, "alpha")}
    assert {tuple(r) for r in D.variable_names(facts["scopes"]).collect()} == {("old", "alpha", 2), ("old", "beta", 1), ("old", "größe", 1)}
    assert D.listing(facts["scopes"], facts["callees"]).groupBy("kind").count().collect() and D.listing(facts["scopes"], facts["callees"]).count() == 3 + 2 + 3
    assert {r.text for r in D.listing(facts["scopes"], facts["callees"], "callees").collect()} == {"callee", "alpha"}
    with pytest.raises(ValueError):
        D.listing(facts["scopes"], facts["callees"], "lines")
    asked = facts["functions"].where("bundle_id = 'new' AND function_id IN (0, 3)").selectExpr("bundle_id", "function_id", "explode(array(0L, 5L, 9L)) AS offset")
    found = {(r.function_id, r.offset): (r.line, r.column) for r in D.located(asked, facts["debug_locations"]).collect()}
    assert found == {(0, 0): (1, 1), (0, 5): (3, 9), (0, 9): (2, 0), (3, 0): (None, None), (3, 5): (None, None), (3, 9): (None, None)}


def objects_mb(run, batches):
    """The most that Python's objects take while run works through batches, in MB."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter(batches)))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


class Held:
    """Stands for a DataFrame, keeps the function of its mapInArrow."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_memory_does_not_grow_with_the_rows_of_an_image():
    streams = {f: [(k, k + 1, f % 9) for k in range(400)] for f in range(200)}
    made = debug.build(96, streams, SCOPES, {})
    data = I.build(96, ["f"], [{"body": BODY, "name_id": 0} for _ in streams], debug=made)
    run = bundles.facts(Held(), "debug_locations").run
    rows, mb = objects_mb(run, [pa.record_batch({"path": ["x"], "content": pa.array([data], pa.binary())})])
    assert rows == 200 * 400 and mb < 10


def test_memory_does_not_grow_with_the_files_of_a_batch(spark, tmp_path, monkeypatch):
    orders = spark.range(1200).selectExpr("id AS o_orderkey", "id div 6 AS o_custkey", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4800).selectExpr("id div 4 AS l_orderkey", "CAST(id % 4 AS INT) + 1 AS l_linenumber", "id % 100 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    held = []
    monkeypatch.setattr(type(orders), "mapInArrow", lambda self, run, _: held.append((self, run)) or self)
    monkeypatch.setattr(P.graphs, "settle", lambda df: df)
    P.debug_images(spark, str(tmp_path))
    (before, run), = held
    few = before.toArrow().combine_chunks()
    many = pa.concat_tables([few] * 20).combine_chunks()
    (rows, small), (rows_20, large) = objects_mb(run, few.to_batches()), objects_mb(run, many.to_batches())
    assert (rows, rows_20) == (200, 4000) and large < 1.5 * small


def test_rows_of_several_images_come_in_batches():
    data = sample(96)
    files = pa.record_batch({"path": [f"p{k}" for k in range(2000)], "content": pa.array([data] * 2000, pa.binary())})
    made = list(bundles.facts(Held(), "debug_locations").run(iter([files])))
    assert sum(b.num_rows for b in made) == 2000 * 4 and len(made) <= 3
    assert made[0].slice(0, 4).to_pylist() == [dict(zip(made[0].schema.names, r, strict=True)) for r in bundles.rows_of("debug_locations", "p0", data, None)]
