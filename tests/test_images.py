import json

import pytest

from lithic.operators import rows
from lithic.sources import bundles
from lithic.sources import image as I

OPCODES = {0: ("LoadUndefined", ["Reg8"]), 1: ("Ret", ["Reg8"]), 2: ("LoadString", ["Reg8", "UInt16S"]), 3: ("JmpShort", ["Addr8"]), 4: ("LoadNumber", ["Reg8", "Double"])}


def sample(version, **more):
    body = I.encode_body([(2, [0, 1]), (4, [1, 2.5]), (3, [-4]), (1, [0])], OPCODES)
    functions = [{"body": body, "name_id": 0, "param_count": 2}, {"body": I.encode_body([(0, [0]), (1, [0])], OPCODES), "name_id": 1, "frame_size": 300, "flags": 6}, {"body": body, "name_id": 2}]
    return I.build(version, ["global", "größe", "x" * 300, "token"], functions, handlers={2: [(0, 4, 6)]}, **more)


@pytest.mark.parametrize("version", [60, 78, 84, 96, 98, 99])
def test_round_trip(version):
    im = I.read(sample(version))
    assert im.diagnostics == []
    assert im.layout == ("modern" if version >= 97 else "legacy")
    assert [s[0] for s in im.strings] == ["global", "größe", "x" * 300, "token"]
    assert [s[1] for s in im.strings] == [False, True, False, False] and all(s[2] for s in im.strings)
    assert [f["name_id"] for f in im.functions] == [0, 1, 2]
    assert im.functions[1]["frame_size"] == 300 and im.functions[1]["flags"] & I.OVERFLOWED
    assert im.handlers == [(2, 0, 0, 4, 6)]
    assert sum(n for name, _, n, _ in im.sections if name == "header") == 128


def test_damage_is_reported_not_raised():
    good = sample(96)
    for k in (130, 200, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 0xFF
        try:
            im = I.read(bytes(bad))
        except I.Damaged:
            continue
        assert ("footer_mismatch", "") in im.diagnostics
    assert dict(I.read(good + b"x").diagnostics)["length_mismatch"]
    for junk in (b"", b"abc", good[:100]):
        with pytest.raises(I.Damaged):
            I.read(junk)


def test_literals_and_numbers():
    buffer = bytes([0x12, 0x71, 5, 0, 0, 0, 0x51, 1, 0, 0x81, 0x02])
    assert I.literals(buffer, 0, 4, [("a",), ("b",)], 96) == [("true", None), ("true", None), ("integer", "5"), ("string", "b")]
    assert I.big_int(b"\xff\xff", 0, 2) == "-1"
    assert I.leb128(b"\x7f", 0) == (-1, 1) and I.leb128(b"\xe5\x8e\x26", 0, signed=False) == (624485, 3)


def test_many_bundles(spark, tmp_path):
    for v in (96, 99):
        (tmp_path / f"b{v}.bin").write_bytes(sample(v))
    (tmp_path / "junk.bin").write_bytes(b"junk")
    ops = tmp_path / "ops"
    ops.mkdir()
    (ops / "t.json").write_text(json.dumps({"Version": 90, "Definitions": [{"Opcode": k, "Name": n, "OperandTypes": t, "IsJump": n == "JmpShort"} for k, (n, t) in OPCODES.items()]}))
    tables = bundles.read_bundles(spark, f"{tmp_path}/*.bin")
    found = {r.bundle_id.rsplit("/", 1)[1]: r for r in tables["bundles"].collect()}
    assert found["junk.bin"].diagnostics[0].code == "unreadable" and found["b96.bin"].version == 96
    assert found["b96.bin"].has_async is False and found["b99.bin"].has_async is None
    assert tables["functions"].count() == 6 and tables["strings"].count() == 8 and tables["exception_handlers"].count() == 2
    opcodes = bundles.opcode_tables(spark, str(ops))
    code = bundles.instructions(tables["bodies"], opcodes)
    one = code.where("function_id = 0").orderBy("bundle_id", "offset").collect()
    assert [r.name for r in one[:4]] == ["LoadString", "LoadNumber", "JmpShort", "Ret"] and one[1].operands[1].val_f == 2.5
    assert {r.table_version for r in bundles.table_version(tables["bundles"].where("version IS NOT NULL"), opcodes).collect()} == {90}
    files = spark.read.format("binaryFile").load(f"{tmp_path}/b*.bin")
    assert sorted(r[0] for r in files.select(bundles.peeked_version()).collect()) == [96, 99]
    inside = rows.in_interval(code.select("bundle_id", "function_id", "offset"), tables["exception_handlers"], ["bundle_id", "function_id"], "offset", "start", "end", 64)
    assert inside.count() == 2
