"""Secret scans through a trigram inverted index, with DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression: alternatives of sets of trigrams (in lower
case) of which every match must contain one set whole. Postings (trigram, document) are made for the trigrams that
occur in some query; intersecting them gives each rule's candidate documents, which the expression then verifies.
A rule from which no mandatory trigram follows scans every text. Positions are code points, ends exclusive.

Candidates are fetched by id: up to FEW of them are sent to where the texts are, which then stay in place; beyond,
texts and candidates are shuffled by id.

Defined results: a null text is empty and has no spans. Rows with a null id are candidates of every rule; of rows
that share an id all are verified if one is a candidate. Repeated rows get equal spans. Ties in start follow the
order of the rules. Extra columns pass through, whatever their names; scan() replaces one named like its result.
"""

from __future__ import annotations

import itertools
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free


@dataclass(frozen=True)
class Rule:
    """pattern: within what Java, RE2 and Python read alike; value_group and least: that group's least length."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 0


#: The contract's kinds, in its order. A run of 24 digits or more is the same match as a run kept for its length.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published token formats.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: So many candidates (id and mask, 24 bytes each) are broadcast.
FEW = 1_000_000
#: Classes of up to so many characters, and so many strings, are enumerated in deriving a query.
MOST_CLASS, MOST_STRINGS = 8, 64
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def grams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def reduced(clauses) -> Query:
    """Without clauses that another one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS:  # weaker, still mandatory: the larger part alone
        return a if a != ANY else b
    return reduced(x | y for x, y in itertools.product(a, b))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigram sets of which each match of pattern contains one; {{}} if nothing is mandatory."""

    def closed(strings: set[str]) -> Query:
        return reduced(grams(s) for s in strings)

    def members(items) -> set[str] | None:
        out: set[str] = set()
        for op, arg in items:
            if op is rc.LITERAL:
                out.add(chr(arg))
            elif op is rc.RANGE and arg[1] - arg[0] < MOST_CLASS:
                out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return out if len({c.lower() for c in out}) <= MOST_CLASS else None

    def walk(seq) -> tuple[set[str] | None, Query]:
        """(all strings that seq can match, or None if too many; query)."""
        query, strings, exact = ANY, {""}, True
        for op, arg in seq:
            part: set[str] | None = None
            sub = ANY
            if op is rc.LITERAL:
                part = {chr(arg)}
            elif op is rc.IN:
                part = members(arg)
            elif op is rc.SUBPATTERN:
                part, sub = walk(arg[3])
            elif op is rc.BRANCH:
                each = [walk(x) for x in arg[1]]
                if all(s is not None for s, _ in each):
                    part = set().union(*(s for s, _ in each))
                else:
                    sub = reduced(c for _, q in each for c in q)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
                low, high, body = arg
                inner, q = walk(body)
                if (low, high) == (0, 1) and inner is not None:
                    part = inner | {""}
                elif low >= 1:
                    sub = q
            elif op is rc.AT:
                part = {""}
            if part is not None and len(strings) * len(part) <= MOST_STRINGS:
                strings = {s + p for s in strings for p in part}
            else:
                exact = False
                query = both(both(query, closed(strings)), sub if part is None else closed(part))
                strings = {""}
        if exact:
            return strings, closed(strings)
        return None, both(query, closed(strings))

    return walk(rp.parse(pattern))[1]


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """_sxid, _sxtri: the inverted index for the given trigrams, by number."""
    low = docs.select(F.col(key).alias("_sxid"), F.lower(text).alias("_sxlow")).where("_sxid IS NOT NULL AND _sxlow IS NOT NULL")
    held = F.array_compact(F.array(*[F.when(F.col("_sxlow").contains(t), F.lit(k)) for k, t in enumerate(trigrams)]))
    return low.select("_sxid", F.explode(held).alias("_sxtri"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame | None:
    """_sxid, _sxmask: the rules (bits) of which the document is a candidate; None if every rule scans fully."""
    clauses = [(r, c, sorted(clause)) for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern)) if clause]
    if not clauses:
        return None
    trigrams = sorted({t for *_, clause in clauses for t in clause})
    rows = [(trigrams.index(t), r, c, 1 << k, (1 << len(clause)) - 1) for r, c, clause in clauses for k, t in enumerate(clause)]
    # As large as the rules: a fixed table.
    wanted = docs.sparkSession.createDataFrame(rows, "_sxt int, _sxrule int, _sxclause int, _sxbit long, _sxall long")
    found = postings(docs, trigrams, key, text).join(F.broadcast(wanted), F.col("_sxtri") == F.col("_sxt"))
    met = found.groupBy("_sxid", "_sxrule", "_sxclause", "_sxall").agg(F.bit_or("_sxbit").alias("_sxgot")).where("_sxgot = _sxall")
    return met.groupBy("_sxid").agg(F.bit_or(F.expr("shiftleft(1L, _sxrule)")).alias("_sxmask"))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches, leftmost and non-overlapping, failing ones dropped."""
    pattern = F.lit(rule.pattern)
    pieces, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.value_group)) if rule.value_group else whole
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("p"), whole.alias("m"), value.alias("v"))
    empty = F.lit(None).cast("array<struct<start:int,kind:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with the column out: array<struct<start, kind (number of the rule), end>>, sorted."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    body = F.coalesce(F.col(text), F.lit(""))
    found = candidates(docs.select(F.col(key).alias("_sxkey"), F.col(text).alias("_sxtext")), rules, "_sxkey", "_sxtext")
    full = [trigram_query(r.pattern) == ANY for r in rules]
    own, met, salt = (free(n, docs.columns) for n in ("_sxmask", "_sxid", "_sxsalt"))
    if found is None:
        joined = docs.withColumn(own, F.lit(0).cast("long"))
    else:
        found = cut(found)
        small = found.count() <= FEW
        found = found.select(F.col("_sxid").alias(met), F.col("_sxmask").alias(own), F.lit(0).cast("long").alias(salt + "0"))
        # Rows without an id meet no candidate; a salt spreads them over the shuffled join.
        salted = docs.withColumn(salt, F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.lit(0)))
        both = (F.col(key) == F.col(met)) & (F.col(salt) == F.col(salt + "0"))
        joined = salted.join(F.broadcast(found) if small else found.hint("shuffle_hash"), both, "left").drop(met, salt, salt + "0")
    mask = F.when(F.col(key).isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce(own, F.lit(0)))
    each = []
    for k, rule in enumerate(rules):
        tried = body.rlike(rule.pattern) if full[k] else mask.bitwiseAND(1 << k) != 0
        each.append(F.when(tried, spans(body, rule, k)).otherwise(none))
    return joined.withColumn(out, F.array_sort(F.concat(*each))).drop(own)


def written(secrets: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < len(BASE))
    return scanned.select(
        key, *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)], F.sha2(written(base, rules), 256).alias("base_sha256"), written(F.col("secrets"), rules).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every secret's span replaced by [SECRET]; overlapping spans are one. Columns stay as they are."""
    held = free("secrets", docs.columns)
    scanned = scan(docs, rules, key, text, held)
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("[SECRET]")).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]) & (acc["at"] > 0), inside).otherwise(fresh)

    clean = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    return scanned.withColumn(text, F.when(F.size(held) > 0, clean).otherwise(body)).select(*[f"`{c}`" for c in docs.columns])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows by DuckDB: positions from the pieces between the matches."""
    per = []
    for k, r in enumerate(rules):
        quoted = r.pattern.replace("'", "''")
        per.append(
            f"SELECT rid, {k} AS kind, '{r.kind}' AS name, {r.least} AS least, string_split_regex(body, '{quoted}') AS p, "
            f"regexp_extract_all(body, '{quoted}', 0) AS m, regexp_extract_all(body, '{quoted}', {r.value_group}) AS v FROM d WHERE regexp_matches(body, '{quoted}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
hits AS ({" UNION ALL ".join(per)}),
each AS (SELECT rid, kind, name, least, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM hits),
placed AS (
  SELECT rid, kind, name, length(v[i]) >= least AS ok,
    list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
  FROM each),
spans AS (SELECT rid, kind, CAST(s AS BIGINT) AS s, name || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS t FROM placed WHERE ok),
per AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(t, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}), '') AS base, coalesce(string_agg(t, ',' ORDER BY s, kind), '') AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""
