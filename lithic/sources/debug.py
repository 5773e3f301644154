"""The debug section of an image: source locations, scopes with their names, called names; a reader and a writer.

A section is a header of counts, a table of file names, file regions, and one region of data that all offsets point
into. Functions point to their own stream of locations and, in the old layout, to their scope. Damage never raises: a
section that cannot be read gives no rows and a status that says why; a stream ends at the first number that is cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, islice

from . import image as I

# Fixed values of the file format: which versions have which layout, and header fields in file order.
OLD_UNTIL, NEW = 96, (98, 99)
COUNTS = ("filename_count", "filename_storage_size", "file_region_count")
REGIONS = ("scopes_at", "callees_at", "strings_at")
FILENAME_SIZE, FILE_REGION_SIZE = 8, 12
NOTHING = 0xFFFFFFFF
END = -1
INNER, DYNAMIC = 1, 2
LONGEST_NUMBER = 10


@dataclass
class Debug:
    status: str
    #: (function, ordinal, offset in the function, line, column, scope or None)
    locations: list[tuple[int, int, int, int, int, int | None]] = field(default_factory=list)
    function_scopes: list[tuple[int, int]] = field(default_factory=list)
    #: (offset, parent or None, flags, names; a name that cannot be found is empty)
    scopes: list[tuple[int, int | None, int, list[str]]] = field(default_factory=list)
    callees: dict[int, str] = field(default_factory=dict)


def is_old(version: int) -> bool | None:
    """Whether a version has the old layout; None for a version of neither."""
    return True if version <= OLD_UNTIL else False if version in NEW else None


def numbers(data: bytes, at: int = 0) -> Iterator[tuple[int, int]]:
    """(signed number, where the next begins), up to the first that is cut or longer than 64 bits can be."""
    while at < len(data):
        try:
            value, size = I.leb128(data[at : at + LONGEST_NUMBER], 0)
        except IndexError:
            return
        at += size
        yield value, at


def encode_number(value: int) -> bytes:
    out = bytearray()
    while not -64 <= value < 64:
        out.append(0x80 | value & 0x7F)
        value >>= 7
    return bytes(out) + bytes([value & 0x7F])


def function_offsets(data: bytes, function: dict, old: bool) -> tuple[int | None, int | None]:
    """Where a function's stream and scope are in the data region: the words after its handlers."""
    at = (function["info_offset"] + 3) & ~3
    if not function["flags"] & I.HAS_DEBUG or not function["info_offset"]:
        return None, None
    if function["flags"] & I.HAS_HANDLERS:
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 > len(data) or n > I.MOST_HANDLERS:
            return None, None
        at += 4 + 12 * n
    words = [int.from_bytes(data[k : k + 4], "little") if k + 4 <= len(data) else NOTHING for k in (at, at + 4)]
    stream, scope = (None if w == NOTHING else w for w in words)
    return stream, scope if old else None


def steps(data: bytes, at: int, old: bool) -> Iterator[tuple[int, int, int, int | None, bool]]:
    """(offset delta, line delta, column delta, scope, whether it is a location); the first is where the function begins."""
    stream = (value for value, _ in numbers(data, at))
    opening = list(islice(stream, 3 if old else 4))
    if len(opening) < (3 if old else 4):
        return
    yield 0, opening[1], opening[2], None, True
    for offset in stream:
        if offset == END:
            return
        line = next(stream, None)
        if line is None:
            return
        if not old and not line & 1:  # an address without location: only the offset moves on
            yield offset, 0, 0, None, False
            continue
        extra = line & 1 if old else (line >> 1 & 1) + (line >> 2 & 1)
        rest = list(islice(stream, (3 if old else 1) + extra))  # column, old: scope and environment; then deltas nobody asks for
        if len(rest) < (3 if old else 1) + extra:
            return
        yield offset, line >> (1 if old else 3), rest[0], rest[1] if old else None, True


def locations(data: bytes, at: int, old: bool) -> list[tuple[int, int, int, int | None]]:
    """(offset, line, column, scope) of one stream: running sums of its steps, none below 0."""
    found = list(steps(data, at, old))
    sums = [[min(max(v, 0), NOTHING) for v in accumulate(s[k] for s in found)] for k in range(3)]
    return [(o, n, c, s[3] if s[3] is not None and 0 <= s[3] <= NOTHING else None) for o, n, c, s in zip(*sums, found, strict=True) if s[4]]


def text_at(strings: bytes, at: int) -> str | None:
    """The string at a byte offset: its length, then its bytes."""
    if at < 0:
        return None
    size, start = next(numbers(strings, at), (-1, 0))
    if size < 0 or start + size > len(strings):
        return None
    try:
        return strings[start : start + size].decode()
    except UnicodeDecodeError:
        return None


def read_scopes(data: bytes, strings: bytes) -> Iterator[tuple[int, int | None, int, list[str]]]:
    at, stream = 0, numbers(data)
    while len(head := list(islice(stream, 3))) == 3:
        (parent, _), (flags, _), (count, end) = head
        if not 0 <= count <= len(data) - end:
            return
        names = list(islice(stream, count))
        yield at, parent if 0 <= parent < NOTHING else None, flags & NOTHING, [text_at(strings, n) or "" for n, _ in names]
        at = names[-1][1] if names else end


def read_callees(data: bytes, strings: bytes) -> dict[int, str]:
    stream = numbers(data)
    count, end = next(stream, (0, 0))
    if not 0 <= count <= len(data) - end:
        return {}
    flat = [value for value, _ in islice(stream, 2 * count)]
    named = ((address & NOTHING, text_at(strings, name)) for address, name in zip(flat[::2], flat[1::2], strict=False))
    return {address: name for address, name in named if name is not None}


@dataclass
class Section:
    status: str
    old: bool = False
    #: what all offsets point into, and in the old layout where its scopes, called names and strings begin
    region: bytes = b""
    bounds: tuple[int, ...] = ()

    def part(self, k: int) -> bytes:
        a, b = self.bounds[k : k + 2]
        return self.region[a:b] if a <= b <= len(self.region) else b""

    def scopes(self) -> Iterator[tuple[int, int | None, int, list[str]]]:
        return read_scopes(self.part(0), self.part(2)) if self.old else iter(())

    def callees(self) -> dict[int, str]:
        return read_callees(self.part(1), self.part(2)) if self.old else {}


def section(data: bytes, image: I.Image) -> Section:
    start, old = image.header["debug_info_offset"], is_old(image.version)
    if start in (0, NOTHING):
        return Section("absent")
    if start >= len(data):
        return Section("offset_out_of_range")
    if old is None:
        return Section("unsupported_version")
    fields = (*COUNTS, *(REGIONS if old else ()), "size")
    if start + 4 * len(fields) > len(data):
        return Section("parse_failed")
    h = dict(zip(fields, struct.unpack_from(f"<{len(fields)}I", data, start), strict=True))
    start += 4 * len(fields) + h["filename_count"] * FILENAME_SIZE + h["filename_storage_size"] + h["file_region_count"] * FILE_REGION_SIZE
    if start + h["size"] > len(data):
        return Section("header_out_of_range")
    return Section("present", old, data[start : start + h["size"]], tuple(h[n] for n in (*REGIONS, "size")) if old else ())


def each_location(data: bytes, image: I.Image, found: Section) -> Iterator[tuple[int, int, int, int, int, int | None]]:
    """The locations of an image, one function's stream in memory at a time."""
    for f in image.functions if found.status == "present" else ():
        stream, _ = function_offsets(data, f, found.old)
        if stream is not None and stream <= len(found.region):
            yield from ((f["function_id"], k, *x) for k, x in enumerate(locations(found.region, stream, found.old)))


def each_function_scope(data: bytes, image: I.Image, found: Section) -> Iterator[tuple[int, int]]:
    for f in image.functions if found.status == "present" else ():
        _, scope = function_offsets(data, f, found.old)
        if scope is not None:
            yield f["function_id"], scope


def read(data: bytes, image: I.Image) -> Debug:
    found = section(data, image)
    return Debug(found.status, list(each_location(data, image, found)), list(each_function_scope(data, image, found)), list(found.scopes()), found.callees())


def build(version: int, streams: dict[int, list[tuple[int, int, int]]], scopes: list[tuple[int | None, int, list[str]]] = (), scope_of: dict[int, int] | None = None, callees: dict[int, str] | None = None) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(section, function: (stream, scope)) for image.build: streams are (offset, line, column) by function, the first at
    offset 0; a scope is (number of its parent, flags, names), and scope_of gives functions the number of theirs.
    """
    old, n = bool(is_old(version)), encode_number
    strings, known, own_scopes, at_scope = bytearray(), {}, bytearray(), []

    def place(s: str) -> int:
        if s not in known:
            known[s] = len(strings)
            strings.extend(n(len(s.encode())) + s.encode())
        return known[s]

    for parent, flags, names in scopes if old else ():
        at_scope.append(len(own_scopes))
        own_scopes += n(-1 if parent is None else at_scope[parent]) + n(flags) + n(len(names)) + b"".join(n(place(s)) for s in names)
    called = n(len(callees or {})) + b"".join(n(a) + n(place(s)) for a, s in sorted((callees or {}).items())) if old else b""
    lines, starts = bytearray(), {}
    for f, points in streams.items():
        starts[f] = len(lines)
        lines += n(f) + n(points[0][1]) + n(points[0][2]) + (b"" if old else n(0))
        scope = at_scope[scope_of[f]] if old and f in (scope_of or {}) else 0
        for (a0, l0, c0), (a1, l1, c1) in zip(points, points[1:], strict=False):
            lines += n(a1 - a0) + (n((l1 - l0) << 1) + n(c1 - c0) + n(scope) + n(0) if old else n((l1 - l0) << 3 | 1) + n(c1 - c0))
        lines += n(END)
    regions = [len(lines), len(lines) + len(own_scopes), len(lines) + len(own_scopes) + len(called)] if old else []
    data = bytes(lines) + bytes(own_scopes) + called + (bytes(strings) if old else b"")
    functions = {f: (starts.get(f, NOTHING), at_scope[scope_of[f]] if old and f in (scope_of or {}) else NOTHING) for f in {**starts, **(scope_of or {})}}
    return struct.pack(f"<{4 + len(regions)}I", 0, 0, 0, *regions, len(data)) + data, functions
