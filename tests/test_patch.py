import pytest

from lithic.sources import image as I
from lithic.sources import patch
from tests.test_images import OPCODES, sample


@pytest.mark.parametrize("version", [96, 99])
def test_strings(version):
    data = sample(version)
    changed = I.read(patch.patch_string_value(data, "token", "nekot"))
    assert changed.strings[3][0] == "nekot" and changed.diagnostics == [] and changed.strings[:3] == I.read(data).strings[:3]
    assert changed.identifier_hashes[3] != I.read(data).identifier_hashes[3]
    for bad in (lambda: patch.patch_string(data, 3, "longer"), lambda: patch.patch_string(data, 3, "tökén"), lambda: patch.patch_string(data, 9, "x"), lambda: patch.patch_string_value(data, "none", "x")):
        with pytest.raises(patch.Refused):
            bad()
    again = patch.retarget_string(data, 3, 0)
    assert I.read(again).strings[3][0] == "global"
    with pytest.raises(patch.Refused):
        patch.patch_string(again, 3, "lobalg")


def test_bodies():
    data = sample(99)
    fresh = patch.patch_operand(data, 0, 0, 1, 3, OPCODES)
    f = I.read(fresh).functions[0]
    assert I.decode_body(fresh[f["offset"] : f["offset"] + f["size"]], OPCODES)[0][4] == [("Reg8", 0), ("UInt16S", 3)]
    for bad in (lambda: patch.patch_operand(data, 0, 0, 1, 70000, OPCODES), lambda: patch.patch_operand(data, 0, 1, 0, 0, OPCODES), lambda: patch.patch_body(data, 0, b"")):
        with pytest.raises(patch.Refused):
            bad()
    assert patch.shifted_handlers([(0, 4, 6), (8, 9, 2)], 4, 3) == [(0, 4, 9), (11, 12, 2)]


def test_listing_round_trip():
    body = I.encode_body([(2, [0, 1]), (4, [1, 2.5]), (3, [-4]), (1, [0])], OPCODES)
    text = patch.listing(body, OPCODES, [(0, 4, 6)])
    assert patch.assembled(text, OPCODES) == (body, [(0, 4, 6)])
    with pytest.raises(patch.Refused):
        patch.assembled("Ret Addr8:1", OPCODES)
