"""Control flow of decoded functions: blocks, edges, and what needs a whole function at a time."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits

KEY = ["bundle_id", "function_id"]
ENDS = ("Ret", "Throw")
SWITCHES = ("SwitchImm", "UIntSwitchImm", "StringSwitchImm")


def jumps(instructions: DataFrame) -> DataFrame:
    """Jump instructions with target; conditional ones fall through too."""
    target = F.filter("operands", lambda o: o["ty"].startswith("Addr"))[0]["val_i"]
    conditional = ~F.col("name").isin("Jmp", "JmpLong", "JmpShort")
    return instructions.where(F.col("name").startswith("J")).select(*KEY, "offset", "length", (F.col("offset") + target).alias("target"), conditional.alias("conditional"))


def all_jumps(instructions: DataFrame, switches: DataFrame | None) -> DataFrame:
    found = jumps(instructions).select(*KEY, "offset", "length", "target")
    return found if switches is None else found.unionByName(switches.select(*KEY, "offset", "length", "target"))


def switch_cases(instructions: DataFrame, tails: DataFrame) -> DataFrame:
    """bundle_id, function_id, offset, length, ordinal, value, string_id, target: the cases of switches over numbers and strings.

    The case without value and string_id is the default; a switch whose table is not wholly there has no other.
    """
    o = lambda k: F.try_element_at("operands", F.lit(k + 1))["val_i"]
    texts = F.col("name") == "StringSwitchImm"
    of = lambda a, b: F.when(texts, a).otherwise(b)
    found = instructions.where(F.col("name").isin(*SWITCHES)).select(
        *KEY, "offset", "length", texts.alias("texts"), of(o(2), o(1)).alias("table"), (F.col("offset") + of(o(3), o(2))).alias("default"),
        of(F.lit(0), o(3)).cast("long").alias("least"), of(o(4), o(4) - o(3) + 1).alias("count"), of(F.lit(8), F.lit(4)).alias("width"),
    )
    place = F.floor((F.col("start") + F.col("offset") + F.col("table") + 3) / 4) * 4 - F.col("start") - F.col("size")
    held = found.join(tails, KEY).withColumn("place", place.cast("long"))
    whole = (F.col("count") > 0) & (F.col("place") >= 0) & (F.col("place") + F.col("count") * F.col("width") <= F.octet_length("tail"))
    entry = held.where(whole).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("at", (F.col("place") + F.col("ordinal") * F.col("width")).cast("int"))
    jump = bits.signed32(bits.unsigned(F.col("tail"), F.col("at") + F.when(F.col("texts"), 4).otherwise(0), 4))
    value, text = F.when(~F.col("texts"), bits.signed32(F.col("least") + F.col("ordinal"))), F.when(F.col("texts"), bits.unsigned(F.col("tail"), F.col("at"), 4))
    cases = entry.select(*KEY, "offset", "length", "ordinal", value.alias("value"), text.alias("string_id"), (F.col("offset") + jump).alias("target"))
    nothing = F.lit(None).cast("long")
    return cases.unionByName(found.select(*KEY, "offset", "length", nothing.alias("ordinal"), nothing.alias("value"), nothing.alias("string_id"), F.col("default").alias("target")))


def blocks(instructions: DataFrame, handlers: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """bundle_id, function_id, block_id, start, end: a block starts at the entry, at jump targets, after jumps and ends, at handler boundaries.

    With switches, what switch_cases gives, their targets and what follows them start blocks too.
    """
    j = all_jumps(instructions, switches)
    starts = (
        instructions.groupBy(*KEY).agg(F.min("offset").alias("offset"))
        .union(j.select(*KEY, "target")).union(j.select(*KEY, F.col("offset") + F.col("length")))
        .union(instructions.where(F.col("name").isin(*ENDS)).select(*KEY, F.col("offset") + F.col("length")))
        .union(handlers.select(*KEY, F.explode(F.array("start", "end", "target"))))
        .distinct().withColumn("is_start", F.lit(1))
    )
    marked = instructions.join(starts, [*KEY, "offset"], "left")
    numbered = marked.withColumn("block_id", F.sum(F.coalesce("is_start", F.lit(0))).over(Window.partitionBy(*KEY).orderBy("offset")) - 1)
    return numbered.groupBy(*KEY, "block_id").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.max_by("name", "offset").alias("last"))


def edges(instructions: DataFrame, cfg: DataFrame, handlers: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """bundle_id, function_id, src, dst, kind: jump, fall (through) or exception."""
    ends = cfg.select(*KEY, F.col("block_id").alias("src"), "end", "last", "start")
    heads = cfg.select(*KEY, F.col("block_id").alias("dst"), F.col("start").alias("at"))
    j = all_jumps(instructions, switches).withColumn("end", F.col("offset") + F.col("length"))
    taken = ends.join(j.select(*KEY, "end", "target"), [*KEY, "end"]).withColumnRenamed("target", "at").join(heads, [*KEY, "at"]).select(*KEY, "src", "dst", F.lit("jump").alias("kind"))
    stops = F.col("last").isin(*ENDS, *SWITCHES, "Jmp", "JmpLong", "JmpShort")
    through = ends.where(~stops).withColumnRenamed("end", "at").join(heads, [*KEY, "at"]).select(*KEY, "src", "dst", F.lit("fall").alias("kind"))
    tries = handlers.select(*KEY, F.col("start").alias("s"), F.col("end").alias("e"), F.col("target").alias("at"))
    caught = ends.join(tries, KEY).where("start >= s AND start < e").join(heads, [*KEY, "at"]).select(*KEY, "src", "dst", F.lit("exception").alias("kind"))
    return taken.union(through).union(caught).distinct()


def live_ranges(definitions: DataFrame, reads: DataFrame) -> DataFrame:
    """bundle_id, function_id, register, definition, range: definitions that a read sees together are one variable.

    reads(…, register, seen array of definitions). Union-find within a function.
    """

    def run(key: tuple, d: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        up = {(int(a), int(b)): (int(a), int(b)) for a, b in zip(d["register"], d["definition"], strict=True)}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for reg, seen in zip(r["register"], r["seen"], strict=True):
            found = [find((int(reg), int(s))) for s in seen if (int(reg), int(s)) in up]
            for a, b in zip(found, found[1:], strict=False):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        number: dict = defaultdict(dict)
        out = []
        for reg, at in sorted(up):
            root = find((reg, at))
            out.append((key[0], key[1], reg, at, number[reg].setdefault(root, len(number[reg]))))
        return pd.DataFrame(out, columns=[*KEY, "register", "definition", "range"])

    return definitions.groupBy(*KEY).cogroup(reads.groupBy(*KEY)).applyInPandas(run, "bundle_id string, function_id long, register long, definition long, range long")


# JavaScript numbers: doubles, with 32-bit wrap-around for bit operators.


def to_int32(x: float) -> int:
    if x != x or x in (float("inf"), float("-inf")):
        return 0
    n = int(x) & 0xFFFFFFFF
    return n - (1 << 32) if n >= 1 << 31 else n


def fold(op: str, a: float, b: float) -> float | bool | None:
    """A binary operator on two numbers, or None if it is not folded."""
    import math

    bits = {"&": lambda: to_int32(a) & to_int32(b), "|": lambda: to_int32(a) | to_int32(b), "^": lambda: to_int32(a) ^ to_int32(b), "<<": lambda: to_int32(float(to_int32(a) << (to_int32(b) & 31))), ">>": lambda: to_int32(a) >> (to_int32(b) & 31), ">>>": lambda: (to_int32(a) & 0xFFFFFFFF) >> (to_int32(b) & 31)}
    if op in bits:
        return float(bits[op]())
    if op in ("<", ">", "<=", ">="):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if op in ("==", "==="):
        return a == b
    if op in ("!=", "!=="):
        return a != b
    try:
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            if b == 0:
                return float("nan") if a == 0 or a != a else math.copysign(float("inf"), a) * math.copysign(1.0, b)
            return a / b
        if op == "%":
            return float("nan") if b == 0 or abs(a) == float("inf") else math.fmod(a, b)
        if op == "**":
            return float("nan") if abs(a) == 1 and abs(b) == float("inf") else math.pow(a, b)
    except (OverflowError, ValueError):
        return None
    return None


def propagate_constants(assigns: DataFrame) -> DataFrame:
    """bundle_id, function_id, ordinal, dst, value: constants of single-assignment registers, folded to a fixpoint.

    assigns(…, ordinal, dst, op, left, right, number): op null is a load of number, `mov` copies left.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        once = rows["dst"].value_counts()
        once = set(once[once == 1].index)
        known: dict = {}
        changed = True
        while changed:
            changed = False
            for dst, op, a, b, n in zip(rows["dst"], rows["op"], rows["left"], rows["right"], rows["number"], strict=True):
                if dst in known or dst not in once:
                    continue
                value = None
                if op is None:
                    value = n
                elif op == "mov":
                    value = known.get(a)
                elif a in known and b in known and not isinstance(known[a], bool) and not isinstance(known[b], bool):
                    value = fold(op, known[a], known[b])
                if value is not None:
                    known[dst], changed = value, True
        hit = rows[rows["dst"].isin(list(known))]
        return pd.DataFrame({"bundle_id": hit["bundle_id"], "function_id": hit["function_id"], "ordinal": hit["ordinal"], "dst": hit["dst"], "value": [float(known[d]) for d in hit["dst"]]})

    return assigns.groupBy(*KEY).applyInPandas(run, "bundle_id string, function_id long, ordinal long, dst string, value double")


def dead_stores(assigns: DataFrame, reads: DataFrame, kept: DataFrame) -> DataFrame:
    """Assignments of names that nothing in the function reads and no nested function keeps."""
    used = reads.select(*KEY, F.col("name").alias("dst")).union(kept.select(*KEY, F.col("name").alias("dst"))).distinct()
    return assigns.join(used, [*KEY, "dst"], "left_anti")


def single_use(assigns: DataFrame, reads: DataFrame) -> DataFrame:
    """Names assigned once and read once, whose expression can stand in their place."""
    once = assigns.groupBy(*KEY, "dst").agg(F.count(F.lit(1)).alias("_d")).where("_d = 1")
    read = reads.groupBy(*KEY, F.col("name").alias("dst")).agg(F.count(F.lit(1)).alias("_u")).where("_u = 1")
    return once.join(read, [*KEY, "dst"]).select(*KEY, "dst")
