"""Changing images: strings, bodies, handlers, text listings. Every change is read back before it is handed out."""

from __future__ import annotations

import hashlib
import struct

from . import image as I


class Refused(ValueError):
    """The change cannot be made without breaking the image."""


def sealed(data: bytes) -> bytes:
    """data with its footer refreshed."""
    body = data[: -I.FOOTER_SIZE]
    return body + hashlib.sha1(body).digest()


def sections_of(im: I.Image) -> dict[str, tuple[int, int]]:
    return {name: (at, size) for name, at, size, _ in im.sections}


def string_entries(data: bytes, im: I.Image) -> list[tuple[bool, int, int]]:
    """(wide, storage offset, length) of each string."""
    at, size = sections_of(im)["small_string_table"]
    over_at, over_size = sections_of(im)["overflow_string_table"]
    overflow = [struct.unpack_from("<II", data, over_at + k) for k in range(0, over_size, 8)]
    out = []
    for k in range(0, size, 4):
        (raw,) = struct.unpack_from("<I", data, at + k)
        wide, offset, length = bool(raw & 1), (raw >> 1) & 0x7FFFFF, raw >> 24
        if length == 0xFF:
            offset, length = overflow[offset]
        out.append((wide, offset, length))
    return out


def patch_string(data: bytes, string_id: int, value: str) -> bytes:
    """In place, if the new text has the old one's length and encoding and no other string shares its bytes."""
    im = I.read(data)
    entries = string_entries(data, im)
    if not 0 <= string_id < len(entries):
        raise Refused(f"no string {string_id}")
    wide, offset, length = entries[string_id]
    if wide == value.isascii():
        raise Refused("another encoding is needed")
    raw = value.encode("utf-16-le" if wide else "ascii")
    size = length * (2 if wide else 1)
    if len(raw) != size:
        raise Refused(f"{len(raw)} bytes in place of {size}")
    for k, (w, o, n) in enumerate(entries):
        if k != string_id and o < offset + size and offset < o + n * (2 if w else 1):
            raise Refused(f"string {k} shares its storage")
    at = sections_of(im)["string_storage"][0] + offset
    out = bytearray(data[:at] + raw + data[at + size :])
    hashes_at, hashes = sections_of(im)["identifier_hashes"]
    identifiers = [k for k, s in enumerate(im.strings) if s[2]]
    if string_id in identifiers and 4 * identifiers.index(string_id) < hashes:
        from ..functions.hashing import jenkins

        struct.pack_into("<I", out, hashes_at + 4 * identifiers.index(string_id), jenkins(value))
    done = sealed(bytes(out))
    if I.read(done).strings[string_id][0] != value:
        raise Refused("the change does not read back")
    return done


def patch_string_value(data: bytes, old: str, new: str) -> bytes:
    """By text: it must stand for exactly one string."""
    found = [k for k, s in enumerate(I.read(data).strings) if s[0] == old]
    if len(found) != 1:
        raise Refused(f"{len(found)} strings read {old!r}")
    return patch_string(data, found[0], new)


def retarget_string(data: bytes, string_id: int, other: int) -> bytes:
    """One string's entry becomes a copy of another's."""
    im = I.read(data)
    at, size = sections_of(im)["small_string_table"]
    if not (0 <= string_id < size // 4 and 0 <= other < size // 4):
        raise Refused("no such string")
    out = bytearray(data)
    out[at + 4 * string_id : at + 4 * string_id + 4] = data[at + 4 * other : at + 4 * other + 4]
    return sealed(bytes(out))


def patch_body(data: bytes, function_id: int, body: bytes) -> bytes:
    """A function's body by one of the same size."""
    im = I.read(data)
    if not 0 <= function_id < len(im.functions):
        raise Refused(f"no function {function_id}")
    f = im.functions[function_id]
    if len(body) != f["size"]:
        raise Refused(f"{len(body)} bytes in place of {f['size']}")
    if any(o is not f and o["offset"] < f["offset"] + f["size"] and f["offset"] < o["offset"] + o["size"] for o in im.functions):
        raise Refused("another function shares the body")
    return sealed(data[: f["offset"]] + body + data[f["offset"] + f["size"] :])


def patch_operand(data: bytes, function_id: int, offset: int, operand: int, value: int, opcodes: dict) -> bytes:
    """One operand of the instruction at offset, if the value fits its width."""
    im = I.read(data)
    f = im.functions[function_id]
    body = data[f["offset"] : f["offset"] + f["size"]]
    for at, op, _, size, operands in I.decode_body(body, opcodes):
        if at != offset:
            continue
        values = [v for _, v in operands]
        values[operand] = value
        try:
            fresh = I.encode_body([(op, values)], opcodes)
        except struct.error as why:
            raise Refused(f"{value} does not fit: {why}") from None
        return patch_body(data, function_id, body[:at] + fresh + body[at + size :])
    raise Refused(f"no instruction at {offset}")


def shifted_handlers(handlers: list[tuple[int, int, int]], at: int, by: int) -> list[tuple[int, int, int]]:
    """(start, end, target) after `by` bytes were put in at offset `at`."""
    move = lambda x: x + by if x >= at else x
    return [(move(s), e + by if e > at else e, move(t)) for s, e, t in handlers]


def listing(body: bytes, opcodes: dict, handlers: list[tuple[int, int, int]] = ()) -> str:
    """A body as text that parses back: one instruction a line, handlers first."""
    lines = [f".handler {s} {e} {t}" for s, e, t in handlers]
    lines += [" ".join([name, *(f"{t}:{v!r}" for t, v in operands)]) for _, _, name, _, operands in I.decode_body(body, opcodes)]
    return "\n".join(lines)


def assembled(text: str, opcodes: dict) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The body and handlers of a listing."""
    by_name = {name: (op, types) for op, (name, types) in opcodes.items()}
    out, handlers = [], []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, *parts = line.split(" ")
        if name == ".handler":
            handlers.append(tuple(map(int, parts)))
            continue
        if name not in by_name:
            raise Refused(f"no opcode {name}")
        op, types = by_name[name]
        pairs = [p.split(":", 1) for p in parts]
        if [t for t, _ in pairs] != types:
            raise Refused(f"{name} takes {types}")
        out.append((op, [float(v) if t == "Double" else int(v) for t, v in pairs]))
    return I.encode_body(out, opcodes), handlers
