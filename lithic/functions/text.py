"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REGEX_SPECIAL = r"([\\.\[\]{}()+?^$|])"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ignoring_case(c: Column, query: str) -> Column:
    """An empty query holds everywhere."""
    return F.lower(c).contains(query.lower()) if query else F.lit(True)


def glob_regex(pattern: str) -> str:
    """`*` alone is special; anchored at both ends, ASCII letters in either case."""
    import re

    return "(?is)^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def matches_glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def parse_list(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """'100-150,200' -> inclusive ranges."""
    out = []
    for part in parse_list(text):
        low, _, high = part.partition("-")
        out.append((int(low), int(high or low)))
    return out


def in_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    hit = F.lit(False)
    for low, high in ranges:
        hit = hit | c.between(low, high)
    return hit


def strip_id_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"/\* [0-9]+ \*/", "")


def normalize_ids(c: Column) -> Column:
    """Ids that change from build to build become #."""
    c = F.regexp_replace(c, "module_[0-9]+", "module_#")
    c = F.regexp_replace(c, r"require\([0-9]+\)", "require(#)")
    return F.regexp_replace(c, r"dependencyMap\[[0-9]+\]", "dependencyMap[#]")


def strip_offsets(c: Column) -> Column:
    """Each line without what stands before a ':' among its first ten characters; lines joined with nothing between."""
    line = lambda x: F.when(F.locate(":", x).between(1, 10), F.substring(x, F.locate(":", x) + 1, F.length(x))).otherwise(x)
    return F.array_join(F.transform(F.split(c, "\n"), line), "")


def truncate_at_line(c: Column, most: int) -> Column:
    """At most so many characters, cut after the last whole line if there is one."""
    head = F.substring(c, 1, most)
    last = F.locate("\n", F.reverse(head))
    cut = F.when(last > 0, F.substring(head, 1, F.length(head) - last)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(cut)


def overlapping_hits(line: Column, query: str) -> Column:
    """All positions (from 0) of query in line; hits may overlap."""
    n = len(query)
    size = F.length(line)
    spots = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(spots, lambda i: F.substring(line, i, F.lit(n)) == query), lambda i: i - 1)


def hex_preview(b: Column, most: int) -> Column:
    """First bytes in hex, space-separated, and how many more there are."""
    shown = F.trim(F.regexp_replace(F.hex(F.substring(b, 1, most)), "(..)", "$1 "))
    rest = F.octet_length(b) - most
    return F.when(rest > 0, F.concat(shown, F.lit(" ... (+"), rest.cast("string"), F.lit(" bytes)"))).otherwise(shown)


def replace_whole_word(c: Column, word: str, by: str) -> Column:
    import re

    return F.regexp_replace(c, rf"(?<![\p{{L}}\p{{Nd}}_$]){re.escape(word)}(?![\p{{L}}\p{{Nd}}_$])", by.replace("\\", "\\\\").replace("$", "\\$"))


def human_size(n: Column) -> Column:
    """Bytes, or KB and MB to one decimal, halves to the even one, without separators."""
    shown = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n / unit, 1))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, shown(1024, "KB")).otherwise(shown(1024 * 1024, "MB"))


def escape_js(c: Column) -> Column:
    """Backslashes, quotes and line ends escaped for a double-quoted literal."""
    for raw, shown in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        c = F.regexp_replace(c, raw, shown)
    return c


def regex_flags(bits: Column) -> Column:
    """Flag bits to letters, in bit order."""
    return F.concat(*[F.when(bits.bitwiseAND(1 << k) != 0, f).otherwise("") for k, f in enumerate("igmusyd")])
