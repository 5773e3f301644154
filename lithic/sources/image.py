"""Bytecode images: field layouts as data, one reader over them, and a builder of small images.

The reader degrades and reports: soft damage becomes a diagnostic of the image, never a failure of the job.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

# Fixed values of the file format: sizes, versions, flags and field orders.
MAGIC = 0x1F1903C103BC1FC6
HEADER_SIZE, FOOTER_SIZE = 128, 20
MODERN_FROM = 97
COMMON_FIELDS = ("file_length", "global_code_index", "function_count", "string_kind_count", "identifier_count", "string_count", "overflow_string_count", "string_storage_size")
#: (field, first version, version from which it is gone or None), in file order.
LEGACY_FIELDS = (
    ("big_int_count", 87, None), ("big_int_storage_size", 87, None), ("reg_exp_count", 0, None), ("reg_exp_storage_size", 0, None), ("array_buffer_size", 0, None),
    ("obj_key_buffer_size", 0, None), ("obj_value_buffer_size", 0, None), ("segment_id", 78, None), ("cjs_module_offset", 0, 78), ("cjs_module_count", 0, None),
    ("function_source_count", 84, None), ("debug_info_offset", 0, None),
)
MODERN_FIELDS = (
    "big_int_count", "big_int_storage_size", "reg_exp_count", "reg_exp_storage_size", "literal_value_buffer_size", "obj_key_buffer_size", "obj_shape_table_count",
    "num_string_switch_imms", "segment_id", "cjs_module_count", "function_source_count", "debug_info_offset",
)
#: Bit fields of the packed function headers: (name, width), from the lowest bit.
LEGACY_FUNCTION = (("offset", 25), ("param_count", 7), ("size", 15), ("name_id", 17), ("info_offset", 25), ("frame_size", 7), ("environment_size", 8), ("read_cache", 8), ("write_cache", 8), ("flags", 8))
MODERN_FUNCTION = {
    98: (("offset", 25), ("param_count", 5), ("loop_depth", 2), ("size", 14), ("name_id", 8), ("number_regs", 5), ("other_regs", 5), ("frame_size", 8), ("read_cache", 8), ("write_cache", 6), ("new_object", 1), ("private_names", 1), ("flags", 8)),
    99: (("offset", 25), ("param_count", 5), ("loop_depth", 2), ("size", 14), ("name_id", 8), ("number_regs", 5), ("other_regs", 5), ("frame_size", 8), ("read_cache", 8), ("write_cache", 7), ("private_names", 1), ("flags", 8)),
}
#: Large function headers: struct codes of the fields in order.
LEGACY_LARGE = ("<IIIIIIIBBB", ("offset", "param_count", "size", "name_id", "info_offset", "frame_size", "environment_size", "read_cache", "write_cache", "flags"))
MODERN_LARGE = {
    98: ("<IIIIIIIIBBBBB", ("offset", "param_count", "loop_depth", "size", "name_id", "number_regs", "other_regs", "frame_size", "read_cache", "write_cache", "new_object", "private_names", "flags")),
    99: ("<IIIIIIIIBBBB", ("offset", "param_count", "loop_depth", "size", "name_id", "number_regs", "other_regs", "frame_size", "read_cache", "write_cache", "private_names", "flags")),
}
STRICT, HAS_HANDLERS, HAS_DEBUG, OVERFLOWED = 0x04, 0x08, 0x10, 0x20
#: Tags of literal buffers, in the high bits of a tag byte.
LITERAL_TAGS = {0x00: "null", 0x10: "true", 0x20: "false", 0x30: "number", 0x40: "string4", 0x50: "string2", 0x60: "string1", 0x70: "integer"}
OPERANDS = {"Reg8": "B", "UInt8": "B", "UInt8S": "B", "Reg32": "I", "UInt32": "I", "UInt32S": "I", "UInt16": "H", "UInt16S": "H", "Addr8": "b", "Addr32": "i", "Imm32": "i", "Double": "d"}
MOST_HANDLERS = 1000


class Damaged(ValueError):
    """The image cannot be read at all in the layout tried."""


@dataclass
class Image:
    version: int
    layout: str
    header: dict
    functions: list[dict] = field(default_factory=list)
    strings: list[tuple[str, bool, bool]] = field(default_factory=list)
    string_kinds: list[tuple[bool, int]] = field(default_factory=list)
    identifier_hashes: list[int] = field(default_factory=list)
    handlers: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sections: list[tuple[str, int, int, int | None]] = field(default_factory=list)
    tables: dict[str, list[tuple[int, int]]] = field(default_factory=dict)
    buffers: dict[str, bytes] = field(default_factory=dict)
    diagnostics: list[tuple[str, str]] = field(default_factory=list)
    instruction_offset: int = 0


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Damaged(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def unpack(self, code: str) -> tuple:
        return struct.unpack(code, self.take(struct.calcsize(code)))

    def align(self) -> None:
        self.at = (self.at + 3) & ~3


def peek_version(data: bytes) -> int:
    if len(data) < 12:
        raise Damaged("too small")
    magic, version = struct.unpack_from("<QI", data)
    if magic != MAGIC:
        raise Damaged("magic")
    return version


def header_fields(version: int, layout: str) -> list[str]:
    if layout == "modern":
        return [*COMMON_FIELDS, *MODERN_FIELDS]
    return [*COMMON_FIELDS, *(n for n, since, gone in LEGACY_FIELDS if since <= version and (gone is None or version < gone))]


def packed(raw: int, fields: tuple) -> dict[str, int]:
    out, at = {}, 0
    for name, width in fields:
        out[name] = (raw >> at) & ((1 << width) - 1)
        at += width
    return out


def read_function(data: bytes, cursor: Cursor, k: int, version: int, layout: str) -> dict:
    if layout == "legacy":
        small = packed(int.from_bytes(cursor.take(16), "little"), LEGACY_FUNCTION)
        code, names = LEGACY_LARGE
        large_at = small["info_offset"] << 16 | small["offset"]
    else:
        if version not in MODERN_FUNCTION:
            raise Damaged(f"no function layout of version {version}")
        small = packed(int.from_bytes(cursor.take(12), "little"), MODERN_FUNCTION[version])
        code, names = MODERN_LARGE[version]
        large_at = small["name_id"] << 24 | small["offset"] & 0xFFFFFF
        small["info_offset"] = 0
    if small["flags"] & OVERFLOWED:
        small = dict(zip(names, Cursor(data, large_at).unpack(code), strict=True))
        small["flags"] |= OVERFLOWED
        small.setdefault("info_offset", (large_at + struct.calcsize(code) + 3) & ~3)
    return {"function_id": k, **small}


def decode_strings(image: Image, small: list[int], overflow: list[tuple[int, int]], storage: bytes) -> None:
    kinds = [identifier for identifier, n in image.string_kinds for _ in range(min(n, len(small)))]
    broken = 0
    for k, raw in enumerate(small):
        wide, offset, length = bool(raw & 1), (raw >> 1) & 0x7FFFFF, raw >> 24
        if length == 0xFF:
            if offset >= len(overflow):
                raise Damaged(f"string {k}: overflow record {offset}")
            offset, length = overflow[offset]
        size = length * 2 if wide else length
        if offset >= len(storage) or offset + size > len(storage):
            value, broken = "<invalid utf16>" if wide else "<invalid utf8>", broken + 1
        else:
            value = storage[offset : offset + size].decode("utf-16-le" if wide else "utf-8", "replace")
        image.strings.append((value, wide, kinds[k] if k < len(kinds) else False))
    if broken:
        image.diagnostics.append(("invalid_string_storage", str(broken)))


def read_handlers(data: bytes, functions: list[dict]) -> list[tuple[int, int, int, int, int]]:
    out = []
    for f in functions:
        at = (f["info_offset"] + 3) & ~3
        if not f["flags"] & HAS_HANDLERS or not f["info_offset"] or at + 4 > len(data):
            continue
        (n,) = struct.unpack_from("<I", data, at)
        if 0 < n <= MOST_HANDLERS and at + 4 + 12 * n <= len(data):
            out += [(f["function_id"], k, *struct.unpack_from("<III", data, at + 4 + 12 * k)) for k in range(n)]
    return out


def read_as(data: bytes, layout: str) -> Image:
    if len(data) < HEADER_SIZE:
        raise Damaged("too small for a header")
    version = peek_version(data)
    cursor = Cursor(data, 12)
    header: dict = {"source_hash": cursor.take(20)}
    header |= {n: cursor.unpack("<I")[0] for n in header_fields(version, layout)}
    header["options_raw"] = cursor.unpack("B")[0]
    image = Image(version, layout, header, sections=[("header", 0, HEADER_SIZE, None)])
    cursor.at = HEADER_SIZE

    def section(name: str, entries: int | None, read):
        cursor.align()
        start = cursor.at
        if entries is not None and entries * 4 > len(data) * 4:
            raise Damaged(f"{name}: {entries} entries")
        found = read()
        image.sections.append((name, start, cursor.at - start, entries))
        return found

    def words(name: str, n: int) -> list[int]:
        return section(name, n, lambda: list(cursor.unpack(f"<{n}I")))

    def pairs(name: str, n: int) -> list[tuple[int, int]]:
        flat = section(name, n, lambda: cursor.unpack(f"<{2 * n}I"))
        return list(zip(flat[::2], flat[1::2], strict=True))

    image.functions = section("function_headers", header["function_count"], lambda: [read_function(data, cursor, k, version, layout) for k in range(header["function_count"])])
    image.string_kinds = [(bool(w >> 31), w & 0x7FFFFFFF) for w in words("string_kinds", header["string_kind_count"])]
    image.identifier_hashes = words("identifier_hashes", header["identifier_count"])
    small = words("small_string_table", header["string_count"])
    overflow = pairs("overflow_string_table", header["overflow_string_count"])
    storage = section("string_storage", None, lambda: cursor.take(header["string_storage_size"]))
    first = ("array_buffer", "obj_key_buffer", "obj_value_buffer") if layout == "legacy" else ("literal_value_buffer", "obj_key_buffer")
    for name in first:
        image.buffers[name] = section(name, None, lambda n=name: cursor.take(header[f"{n}_size"]))
    if layout == "modern":
        image.tables["obj_shapes"] = pairs("obj_shape_table", header["obj_shape_table_count"])
    for kind in ("big_int", "reg_exp"):
        if f"{kind}_count" in header:
            image.tables[kind] = pairs(f"{kind}_table", header[f"{kind}_count"])
            image.buffers[kind] = section(f"{kind}_storage", None, lambda k=kind: cursor.take(header[f"{k}_storage_size"]))
    image.tables["cjs_modules"] = pairs("cjs_module_table", header["cjs_module_count"])
    if "function_source_count" in header:
        image.tables["function_sources"] = pairs("function_source_table", header["function_source_count"])
    image.instruction_offset = cursor.at
    decode_strings(image, small, overflow, storage)
    image.handlers = read_handlers(data, image.functions)
    if header["file_length"] != len(data):
        image.diagnostics.append(("length_mismatch", f"{header['file_length']} declared, {len(data)} read"))
    if hashlib.sha1(data[:-FOOTER_SIZE]).digest() != data[-FOOTER_SIZE:]:
        image.diagnostics.append(("footer_mismatch", ""))
    return image


def read(data: bytes, layout: str | None = None) -> Image:
    """layout 'legacy' or 'modern', or by the version; if that fails the other one, which is recorded."""
    if layout:
        return read_as(data, layout)
    first, other = ("modern", "legacy") if peek_version(data) >= MODERN_FROM else ("legacy", "modern")
    try:
        return read_as(data, first)
    except Damaged as why:
        try:
            image = read_as(data, other)
        except Damaged:
            raise why from None
        image.diagnostics.append(("layout_fallback", f"{first} failed: {why}"))
        return image


def options(raw: int, version: int) -> dict:
    return {"static_builtins": bool(raw & 1), "cjs_resolved": bool(raw & 2), "has_async": None if version >= 98 else bool(raw & 4)}


def literals(buffer: bytes, offset: int, count: int, strings: list, version: int) -> list[tuple[str, str | None]]:
    """(kind, text) of count literals from offset on; a string id without string is kept as such."""
    cursor, out = Cursor(buffer, offset), []
    while len(out) < count:
        (tag,) = cursor.unpack("B")
        n = tag & 0x0F
        if tag & 0x80:
            n = n << 8 | cursor.unpack("B")[0]
        kind = LITERAL_TAGS[tag & 0x70]
        if kind == "string1" and version >= 98:
            kind = "undefined"
        for _ in range(min(n, count - len(out))):
            if kind == "number":
                out.append((kind, repr(cursor.unpack("<d")[0])))
            elif kind == "integer":
                out.append((kind, str(cursor.unpack("<i")[0])))
            elif kind.startswith("string"):
                (i,) = cursor.unpack({"string1": "B", "string2": "<H", "string4": "<I"}[kind])
                out.append(("string", strings[i][0] if i < len(strings) else f"<string:{i}>"))
            else:
                out.append((kind, None))
    return out


def big_int(storage: bytes, offset: int, length: int) -> str | None:
    """Little-endian two's complement to decimal text."""
    return str(int.from_bytes(storage[offset : offset + length], "little", signed=True)) if offset + length <= len(storage) else None


def leb128(data: bytes, at: int, signed: bool = True) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            break
    if signed and b & 0x40:
        value -= 1 << shift
    return value, at


def decode_body(body: bytes, opcodes: dict[int, tuple[str, list[str]]]) -> list[tuple[int, int, str, int, list[tuple[str, float | int]]]]:
    """(offset, opcode, name, length, operands); stops at the first byte that no opcode explains."""
    out, at = [], 0
    while at < len(body) and body[at] in opcodes:
        name, types = opcodes[body[at]]
        code = "<B" + "".join(OPERANDS[t] for t in types)
        size = struct.calcsize(code)
        if at + size > len(body):
            break
        op, *values = struct.unpack_from(code, body, at)
        out.append((at, op, name, size, list(zip(types, values, strict=True))))
        at += size
    return out


def encode_body(instructions: list[tuple[int, list]], opcodes: dict[int, tuple[str, list[str]]]) -> bytes:
    return b"".join(struct.pack("<B" + "".join(OPERANDS[t] for t in opcodes[op][1]), op, *values) for op, values in instructions)


def build(version: int, strings: list[str], functions: list[dict], *, handlers: dict[int, list[tuple[int, int, int]]] | None = None, options_raw: int = 0, tables: dict | None = None, buffers: dict | None = None, debug: tuple[bytes, dict[int, tuple[int, int]]] | None = None) -> bytes:
    """A sealed image: functions have body, name_id and optionally param_count, frame_size, flags; strings are identifiers.

    A function's table of jumps, if any, follows its body and is not of its size. Functions with handlers, debug offsets or large fields get an out-of-line header; debug is what debug.build gives.
    """
    handlers, tables, buffers = handlers or {}, tables or {}, buffers or {}
    section, debug_offsets = debug or (b"", {})
    layout = "modern" if version >= MODERN_FROM else "legacy"
    names = header_fields(version, layout)
    storage, small, overflow = bytearray(), [], []
    for s in strings:
        wide = not s.isascii()
        raw = s.encode("utf-16-le" if wide else "ascii", "surrogatepass")
        if wide and len(storage) % 2:
            storage.append(0)
        n = len(raw) // 2 if wide else len(raw)
        if n >= 0xFF:
            small.append(0xFF << 24 | len(overflow) << 1 | wide)
            overflow.append((len(storage), n))
        else:
            small.append(n << 24 | len(storage) << 1 | wide)
        storage += raw
    from ..functions.hashing import jenkins

    hashes = [jenkins(s) for s in strings]
    flat = lambda rows: b"".join(struct.pack("<II", *r) for r in rows)
    body_parts: list[bytes] = []

    def pad(b: bytes) -> bytes:
        return b + b"\x00" * (-len(b) % 4)

    parts = [
        struct.pack("<I", 1 << 31 | len(strings)) if strings else b"", struct.pack(f"<{len(hashes)}I", *hashes), struct.pack(f"<{len(small)}I", *small), flat(overflow), bytes(storage),
        *(buffers.get(n, b"") for n in (("array_buffer", "obj_key_buffer", "obj_value_buffer") if layout == "legacy" else ("literal_value_buffer", "obj_key_buffer"))),
    ]
    if layout == "modern":
        parts.append(flat(tables.get("obj_shapes", [])))
    for kind in ("big_int", "reg_exp"):
        if f"{kind}_count" in names:
            parts += [flat(tables.get(kind, [])), buffers.get(kind, b"")]
    parts.append(flat(tables.get("cjs_modules", [])))
    if "function_source_count" in names:
        parts.append(flat(tables.get("function_sources", [])))
    function_size = 16 if layout == "legacy" else 12
    start = HEADER_SIZE + function_size * len(functions)
    for p in parts:
        start = ((start + 3) & ~3) + len(p)
    bodies_at, at = [], start
    for f in functions:
        bodies_at.append(at)
        body_parts.append(f["body"])
        at += len(f["body"])
        if "table" in f:  # jump tables begin at a multiple of four
            body_parts.append(b"\x00" * (-at % 4) + f["table"])
            at += len(body_parts[-1])
    tail = b"".join(body_parts)
    tail += b"\x00" * (-at % 4)
    at += -at % 4
    fields = LEGACY_FUNCTION if layout == "legacy" else MODERN_FUNCTION[version]
    code, large_names = LEGACY_LARGE if layout == "legacy" else MODERN_LARGE[version]
    heads = b""
    for k, f in enumerate(functions):
        row = {"offset": bodies_at[k], "param_count": f.get("param_count", 1), "size": len(f["body"]), "name_id": f.get("name_id", 0), "frame_size": f.get("frame_size", 1), "flags": f.get("flags", 2)}
        own = handlers.get(k, [])
        if own:
            row["flags"] |= HAS_HANDLERS
        if k in debug_offsets:
            row["flags"] |= HAS_DEBUG
        widths = dict(fields)
        if own or k in debug_offsets or any(v >> widths[n] for n, v in row.items()):
            info = (at + struct.calcsize(code) + 3) & ~3
            row["info_offset"] = info
            large = struct.pack(code, *(row.get(n, 0) for n in large_names))
            block = large + b"\x00" * (info - at - len(large)) + (struct.pack("<I", len(own)) if own or k not in debug_offsets else b"") + b"".join(struct.pack("<III", *h) for h in own)
            if k in debug_offsets:
                stream, scope = debug_offsets[k]
                block += struct.pack("<III", stream, scope, 0xFFFFFFFF) if layout == "legacy" else struct.pack("<I", stream)
            row = {"flags": OVERFLOWED}
            row |= {"offset": at & 0xFFFF, "info_offset": at >> 16} if layout == "legacy" else {"offset": at & 0xFFFFFF, "name_id": at >> 24}
            tail += pad(block)
            at += len(pad(block))
        raw = shift = 0
        for n, width in fields:
            raw |= row.get(n, 0) << shift
            shift += width
        heads += raw.to_bytes(function_size, "little")
    debug_at = at if section else 0
    tail += pad(section)
    at += len(pad(section))
    values = {
        "file_length": at + FOOTER_SIZE, "function_count": len(functions), "string_kind_count": int(bool(strings)), "identifier_count": len(hashes), "string_count": len(strings),
        "overflow_string_count": len(overflow), "string_storage_size": len(storage), "debug_info_offset": debug_at,
    }
    for n in names:
        if n.endswith("_buffer_size"):
            values[n] = len(buffers.get(n[:-5], b""))
        elif n in ("big_int_storage_size", "reg_exp_storage_size"):
            values[n] = len(buffers.get(n[: -len("_storage_size")], b""))
        elif n.endswith("_count") and n not in values:
            values[n] = len(tables.get({"obj_shape_table_count": "obj_shapes", "cjs_module_count": "cjs_modules", "function_source_count": "function_sources"}.get(n, n[:-6]), []))
    out = struct.pack("<QI", MAGIC, version) + b"\x00" * 20 + b"".join(struct.pack("<I", values.get(n, 0)) for n in names) + bytes([options_raw])
    out = out.ljust(HEADER_SIZE, b"\x00") + heads
    for p in parts:
        out = pad(out) + p
    out += tail
    return out + hashlib.sha1(out).digest()
