import json

import pytest

from lithic.api import Bundles
from tests.test_images import OPCODES, sample


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bundles")
    (at / "a.bin").write_bytes(sample(96))
    (at / "b.bin").write_bytes(sample(99))
    (at / "ops").mkdir()
    (at / "ops" / "t.json").write_text(json.dumps({"Version": 90, "Definitions": [{"Opcode": k, "Name": n, "OperandTypes": t, "IsJump": n == "JmpShort"} for k, (n, t) in OPCODES.items()]}))
    return Bundles(spark, f"{at}/*.bin", f"{at}/ops")


def test_questions(asked):
    assert asked.info().count() == 2 and asked.warnings().count() == 0
    assert {r.opcode for r in asked.xref("GRÖSSE".lower().replace("ss", "ß")).collect()} == {"LoadString"}
    assert asked.xref("größe").count() == 4 and asked.xref("größe", limit=1, offset=1).count() == 1
    assert {r.name for r in asked.functions_named("glob").collect()} == {"global"}
    assert asked.dump("strings").count() == 8 and asked.dump("cjs_modules").count() == 0
    assert asked.disassemble().count() == 6 and asked.blocks().count() >= 6 and asked.flow().count() > 0
    a, b = sorted(r.bundle_id for r in asked.info().collect())
    assert {r.status for r in asked.compare(a, b).collect()} == {"identical"}
    with pytest.raises(ValueError):
        Bundles(asked.spark, a).instructions
