import json
import struct

import pytest

from lithic.api import Bundles
from lithic.sources import debug
from lithic.sources import image as I

OPCODES = {0: ("Ret", ["Reg8"]), 1: ("SwitchImm", ["Reg8", "UInt32", "Addr32", "UInt32", "UInt32"]), 2: ("StringSwitchImm", ["Reg8", "UInt32", "UInt32", "Addr32", "UInt32"]), 3: ("CallBuiltin", ["Reg8", "UInt8", "UInt8"])}
SIZE = 1 + 1 + 16


def function(op, operands, table, rest=3):
    body = I.encode_body([(op, operands)] + [(0, [k]) for k in range(rest)], OPCODES)
    return {"body": body, "name_id": 0, "table": table}


def sample(version):
    end = SIZE + 6
    numbers = function(1, [0, end, SIZE, 5, 7], struct.pack("<iii", SIZE + 2, SIZE + 4, SIZE + 2))
    texts = function(2, [0, 9, end, SIZE + 4, 2], struct.pack("<IiIi", 1, SIZE, 0, SIZE + 2))
    broken = function(1, [0, end, SIZE, 0, 4_000_000_000], b"")
    reverse = function(1, [0, end, SIZE, 7, 5], b"\x00" * 12)
    calls = {"body": I.encode_body([(3, [0, 1, 2]), (3, [0, 9, 2]), (0, [0])], OPCODES), "name_id": 0}
    return I.build(version, ["f", "text"], [numbers, texts, broken, reverse, calls], debug=debug.build(version, {4: [(0, 5, 1), (4, 6, 2)]}))


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("switches")
    (at / "a.bin").write_bytes(sample(96))
    (at / "b.bin").write_bytes(sample(99))
    for folder in ("ops", "builtins"):
        (at / folder).mkdir()
    (at / "ops" / "t.json").write_text(json.dumps({"Version": 90, "Definitions": [{"Opcode": k, "Name": n, "OperandTypes": t, "IsJump": False} for k, (n, t) in OPCODES.items()]}))
    (at / "builtins" / "Names90.json").write_text('["a.b",\n "c.d"]')
    (at / "builtins" / "Names98.json").write_text('["a.b", "x.y"]')
    return Bundles(spark, f"{at}/*.bin", f"{at}/ops"), f"{at}/builtins"


def short(r):
    return r.bundle_id[-5]


def test_cases(asked):
    found = asked[0].switches().collect()
    for b in "ab":
        rows = {(r.function_id, r.value, r.string_id, r.target) for r in found if short(r) == b}
        assert rows == {
            (0, 5, None, SIZE + 2), (0, 6, None, SIZE + 4), (0, 7, None, SIZE + 2), (0, None, None, SIZE), (1, None, 1, SIZE), (1, None, 0, SIZE + 2), (1, None, None, SIZE + 4), (2, None, None, SIZE), (3, None, None, SIZE),
        }


def test_flow(asked):
    edges = {(r.function_id, r.src, r.dst, r.kind) for r in asked[0].flow().collect() if short(r) == "a"}
    assert edges == {(0, 0, k, "jump") for k in (1, 2, 3)} | {(1, 0, k, "jump") for k in (1, 2, 3)} | {(2, 0, 1, "jump"), (3, 0, 1, "jump")}


def test_builtins_versions_lines(asked):
    bundles, builtins = asked
    found = {(short(r), r.offset, r.builtin, r.name) for r in bundles.builtin_calls(builtins).collect()}
    assert found == {("a", 0, 1, "c.d"), ("a", 4, 9, None), ("b", 0, 1, "x.y"), ("b", 4, 9, None)}
    assert [r.version for r in bundles.versions().collect()] == [90]
    assert {(r.offset, r.line, r.column) for r in bundles.lines().where("function_id = 4").collect()} == {(0, 5, 1), (4, 6, 2), (8, 6, 2)}
    assert bundles.debug_info().count() == 0 and bundles.variables().count() == 0
