"""Expressions and statements as tuples: (kind, ...). Rewrites are bottom-up and iterative, so depth is no limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

# Expressions: ("num", v) ("str", s) ("bool", b) ("null",) ("undefined",) ("this",) ("global",) ("reg", n) ("param", k)
# ("fn", id) ("env", level, slot) ("bin", op, a, b) ("un", op, a) ("get", obj, key) ("call", f, args...) ("new", f, args...)
# ("obj", (key, value)...) ("arr", v...) ("cond", c, a, b) ("regexp", p, f) ("template", part...)
# Statements: ("set", target, e) ("do", e) ("return", e) ("throw", e) ("if", c, then, else) ("while", c, body)
# ("goto", label) ("label", label) ("branch", c, label) ("comment", text)

LEAVES = {"num", "str", "bool", "null", "undefined", "this", "global", "reg", "param", "fn", "env", "name", "regexp", "hole"}
STATEMENTS = {"set", "do", "return", "throw", "if", "while", "goto", "label", "branch", "comment"}
PRECEDENCE = {"**": 14, "*": 13, "/": 13, "%": 13, "+": 12, "-": 12, "<<": 11, ">>": 11, ">>>": 11, "<": 10, "<=": 10, ">": 10, ">=": 10, "in": 10, "instanceof": 10, "==": 9, "!=": 9, "===": 9, "!==": 9, "&": 8, "^": 7, "|": 6, "&&": 5, "||": 4, "??": 4}
NEGATED = {"==": "!=", "!=": "==", "===": "!==", "!==": "==="}


def parts(e: tuple) -> list[tuple]:
    """Subexpressions, in evaluation order."""
    if e[0] in LEAVES:
        return []
    if e[0] == "obj":
        return [v for _, v in e[1:]]
    return [x for x in e[1:] if isinstance(x, tuple)]


def with_parts(e: tuple, new: list[tuple]) -> tuple:
    if e[0] in LEAVES:
        return e
    if e[0] == "obj":
        return ("obj", *((k, v) for (k, _), v in zip(e[1:], new, strict=True)))
    rest = iter(new)
    return tuple(next(rest) if isinstance(x, tuple) else x for x in e)


def rewrite(e: tuple, rule: Callable[[tuple], tuple]) -> tuple:
    """rule applied to every node, innermost first."""
    stack: list = [(e, None)]
    done: list[tuple] = []
    while stack:
        node, n = stack.pop()
        if n is None:
            kids = parts(node)
            stack.append((node, len(kids)))
            stack += [(k, None) for k in reversed(kids)]
        else:
            kids = done[len(done) - n :] if n else []
            del done[len(done) - n :]
            done.append(rule(with_parts(node, kids) if n else node))
    return done[0]


def walk(e: tuple) -> Iterator[tuple]:
    stack = [e]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(parts(node))


def expressions(s: tuple) -> list[tuple]:
    """Expressions that a statement itself evaluates (not those of its bodies)."""
    if s[0] == "set":
        return [s[2]] if s[1][0] in ("reg", "env", "name") else [*parts(s[1]), s[2]]
    return [s[1]] if s[0] in ("do", "return", "throw", "if", "while", "branch") else []


def map_expressions(body: list[tuple], f: Callable[[tuple], tuple]) -> list[tuple]:
    out = []
    for s in body:
        if s[0] == "set":
            target = s[1] if s[1][0] in ("reg", "env", "name") else with_parts(s[1], [f(x) for x in parts(s[1])])
            out.append(("set", target, f(s[2])))
        elif s[0] == "if":
            out.append(("if", f(s[1]), map_expressions(s[2], f), map_expressions(s[3], f)))
        elif s[0] == "while":
            out.append(("while", f(s[1]), map_expressions(s[2], f)))
        elif s[0] in ("do", "return", "throw"):
            out.append((s[0], f(s[1])))
        elif s[0] == "branch":
            out.append(("branch", f(s[1]), s[2]))
        else:
            out.append(s)
    return out


def all_statements(body: list[tuple]) -> Iterator[tuple]:
    for s in body:
        yield s
        if s[0] == "if":
            yield from all_statements(s[2])
            yield from all_statements(s[3])
        elif s[0] == "while":
            yield from all_statements(s[2])


def reads(body: list[tuple]) -> Counter:
    found: Counter = Counter()
    for s in all_statements(body):
        for e in expressions(s):
            found.update(x[1] for x in walk(e) if x[0] == "reg")
    return found


def writes(body: list[tuple]) -> Counter:
    return Counter(s[1][1] for s in all_statements(body) if s[0] == "set" and s[1][0] == "reg")


def has_effects(e: tuple) -> bool:
    """True if leaving e out or moving it could be seen."""
    return any(x[0] in ("call", "new", "get") or (x[0] == "un" and x[1] == "delete") or (x[0] == "bin" and x[1] in ("in", "instanceof")) for x in walk(e))


def reads_state(e: tuple) -> bool:
    return any(x[0] in ("call", "new", "get", "env", "global") for x in walk(e))
