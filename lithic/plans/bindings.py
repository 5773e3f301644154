"""The relational operators bound to the driver's tables, each with the same query in SQL.

documents stand for functions (name: lang, body: text, bundle: source), their blank-separated tokens for strings and
instructions, shipped line items for call sites, customers' and suppliers' nations for a call graph, events for
instruction streams and debug locations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import diff, facts, graphs, rows, xref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """function_id, offset, value: the instruction stream of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.col("doc_id").alias("function_id"), F.posexplode(F.split("text", " ")).alias("offset", "value"))


TOKENS = "SELECT doc_id AS function_id, unnest(range(0, len(string_split(text, ' ')))) AS \"offset\", unnest(string_split(text, ' ')) AS value FROM documents"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: nation of the customer to nation of the supplier."""
    line = table(spark, sf_dir, "lineitem")
    orders, customer, supplier = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


EDGES = """SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


# Cross references


@query(f"SELECT function_id, \"offset\", value FROM ({TOKENS}) WHERE contains(lower(value), 'token')")
def xref_string(spark, sf_dir):
    uses = tokens(spark, sf_dir)
    return xref.xref_string(uses.select("value"), uses, "token")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND (CAST(floor(value) AS BIGINT) = 42 OR user_id = 42)")
def xref_operand(spark, sf_dir):
    ops = F.array(F.struct(F.col("event_type").alias("ty"), F.floor("value").alias("val")), F.struct(F.col("event_type").alias("ty"), F.col("user_id").alias("val")))
    return xref.xref_operand(table(spark, sf_dir, "events").withColumn("ops", ops), "ops", ("click", "view", "purchase"), 42).select("event_id", "user_id")


@query(f"""SELECT DISTINCT name FROM (
SELECT source AS name FROM documents WHERE contains(lower(source), '19')
UNION ALL SELECT d.source FROM documents d SEMI JOIN (SELECT function_id FROM ({TOKENS}) WHERE contains(lower(value), 'secret')) h ON d.doc_id = h.function_id)""")
def deep_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("function_id"), F.col("source").alias("name"))
    uses = tokens(spark, sf_dir)
    hits = xref.xref_string(uses.select("value"), uses, "secret")
    return xref.deep_search(docs.select("name").distinct(), hits, docs, "function_id", "name", "19")


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN '' ELSE p_name END, ''), 'f' || CAST(p_partkey AS VARCHAR)) AS name FROM part")
def name_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select("p_partkey", F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name")).alias("name"))
    return xref.with_names(part.select("p_partkey"), names, "p_partkey", "name", F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).select("p_partkey", "name")


@query("SELECT p_brand, p_size, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size, p_name HAVING count(DISTINCT p_partkey) = 1")
def unique_name_resolve(spark, sf_dir):
    return xref.unique_names(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name"), "p_partkey", "p_name", ("p_brand", "p_size"))


@query("SELECT p_name AS name, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_name")
def name_index(spark, sf_dir):
    found = xref.name_index(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey", "name")
    return found.select("name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT o_orderkey, coalesce(CAST(n_nationkey AS BIGINT), s_suppkey, -1) AS callee FROM orders
LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ON o_custkey % 100 = n_nationkey
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON o_custkey % 100 = s_suppkey""")
def callee_resolution(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"))
    first = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("v"))
    second = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("b"), F.col("s_suppkey").alias("w"))
    found = xref.resolve(calls, "k", [(first, "a", "v"), (second, "b", "w")], "callee")
    return found.select("o_orderkey", F.coalesce("callee", F.lit(-1)).alias("callee"))


@query("SELECT DISTINCT page_id FROM pages WHERE contains(html, 'href=\"/the\"')")
def dependents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    deps = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("dep"))
    return xref.dependents(deps, "page_id", "dep", F.lit("the"))


@query("""SELECT o_custkey AS module, arg_min(name, prio) AS name FROM (
SELECT o_custkey, name, prio, count(DISTINCT item) AS got, any_value(need) AS need FROM (SELECT DISTINCT o_custkey, o_orderpriority AS item FROM orders)
JOIN (VALUES ('urgent', 1, '1-URGENT', 2), ('urgent', 1, '2-HIGH', 2), ('calm', 2, '5-LOW', 1)) AS r(name, prio, item, need) USING (item)
GROUP BY o_custkey, name, prio) WHERE got = need GROUP BY o_custkey""")
def known_library(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("item"))
    required = spark.createDataFrame([("urgent", 1, "1-URGENT"), ("urgent", 1, "2-HIGH"), ("calm", 2, "5-LOW")], "name string, prio int, item string")
    return xref.division(have, required, "module", "item", "name", "prio")


@query("""SELECT l_partkey AS module, arg_min(name, prio) AS name FROM (
SELECT l_partkey, name, prio, least, count(DISTINCT item) AS got FROM (SELECT DISTINCT l_partkey, CAST(l_linenumber AS INTEGER) AS item FROM lineitem)
JOIN (VALUES ('low', 1, 1, 2), ('low', 1, 2, 2), ('low', 1, 3, 2), ('high', 2, 6, 1), ('high', 2, 7, 1)) AS r(name, prio, item, least) USING (item)
GROUP BY l_partkey, name, prio, least) WHERE got >= least GROUP BY l_partkey""")
def prop_signature(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("module"), F.col("l_linenumber").cast("int").alias("item"))
    signatures = spark.createDataFrame([("low", 1, 1, 2), ("low", 1, 2, 2), ("low", 1, 3, 2), ("high", 2, 6, 1), ("high", 2, 7, 1)], "name string, prio int, item int, least int")
    return xref.signature(have, signatures, "module", "item", "name", "prio", "least")


# Diff


def builds(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("text").alias("body"), F.substring("source", 4, 9).cast("int").alias("s"))
    return docs.where("s < 10").drop("s"), docs.where("s >= 10").drop("s")


PAIRS = """WITH d AS (SELECT doc_id AS id, lang AS name, sha256(text) AS h, CAST(substr(source, 4) AS INTEGER) < 10 AS old FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY name, h ORDER BY id) AS k FROM d WHERE old), b AS (SELECT *, row_number() OVER (PARTITION BY name, h ORDER BY id) AS k FROM d WHERE NOT old),
same AS (SELECT a.name, a.id AS old_id, b.id AS new_id FROM a JOIN b ON a.name = b.name AND a.h = b.h AND a.k = b.k),
ra AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM a WHERE id NOT IN (SELECT old_id FROM same)),
rb AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM b WHERE id NOT IN (SELECT new_id FROM same)),
p AS (SELECT * FROM same UNION ALL SELECT coalesce(ra.name, rb.name) AS name, ra.id AS old_id, rb.id AS new_id FROM ra FULL JOIN rb ON ra.name = rb.name AND ra.k = rb.k),
st AS (SELECT p.name, old_id, new_id, CASE WHEN new_id IS NULL THEN 'removed' WHEN old_id IS NULL THEN 'added' WHEN x.h = y.h THEN 'identical' ELSE 'modified' END AS status
FROM p LEFT JOIN d x ON x.id = old_id LEFT JOIN d y ON y.id = new_id)"""


@query(f"{PAIRS} SELECT name, old_id, new_id FROM p")
def bindiff_pairs(spark, sf_dir):
    return diff.pair(*builds(spark, sf_dir))


@query(f"{PAIRS} SELECT * FROM st")
def bindiff_status(spark, sf_dir):
    old, new = builds(spark, sf_dir)
    return diff.statuses(diff.pair(old, new), old, new)


@query(f"{PAIRS} SELECT count(*) FILTER (status = 'identical') AS identical, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'added') AS added FROM st")
def bindiff_summary(spark, sf_dir):
    old, new = builds(spark, sf_dir)
    return diff.summary(diff.statuses(diff.pair(old, new), old, new))


@query("""WITH d AS (SELECT source AS name, text, CAST(substr(source, 4) AS INTEGER) < 10 AS old FROM documents)
SELECT a.name, min(b.name) AS new_name FROM d a JOIN d b ON a.old AND NOT b.old AND a.text = b.text AND a.text <> ''
WHERE a.name NOT IN (SELECT name FROM d WHERE NOT old) AND b.name NOT IN (SELECT name FROM d WHERE old) GROUP BY a.name""")
def rename_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("text").alias("body"), F.substring("source", 4, 9).cast("int").alias("s"))
    return diff.renames(docs.where("s < 10").drop("s"), docs.where("s >= 10").drop("s"))


@query()
def line_alignment(spark, sf_dir):
    old, new = builds(spark, sf_dir)
    pairs = diff.pair(old, new).where("old_id IS NOT NULL AND new_id IS NOT NULL")
    both = pairs.join(old.select(F.col("id").alias("old_id"), F.col("body").alias("a")), "old_id").join(new.select(F.col("id").alias("new_id"), F.col("body").alias("b")), "new_id")
    lines = diff.aligned_lines(both.select("old_id", "new_id", "a", "b"), "a", "b")
    return lines.groupBy("old_id", "new_id", "kind").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT doc_id, sha256(list_reduce(list_prepend('', list_transform(string_split(text, chr(10)), lambda x: CASE WHEN instr(x, ':') BETWEEN 1 AND 10 THEN substr(x, instr(x, ':') + 1) ELSE x END)), lambda a, b: a || b)) AS h FROM documents")
def strip_offsets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_offsets(F.col("text")), 256).alias("h"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace('module_' || CAST(page_id AS VARCHAR) || ' require(' || CAST(page_id AS VARCHAR) || ') dependencyMap[' || CAST(page_id AS VARCHAR) || '] ' || url,
'module_[0-9]+', 'module_#', 'g'), 'require\\([0-9]+\\)', 'require(#)', 'g'), 'dependencyMap\\[[0-9]+\\]', 'dependencyMap[#]', 'g') AS t FROM pages""")
def normalize_ids(spark, sf_dir):
    i = F.col("page_id").cast("string")
    text = F.concat(F.lit("module_"), i, F.lit(" require("), i, F.lit(") dependencyMap["), i, F.lit("] "), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_ids(text).alias("t"))


# Filters, paging, text


@query("SELECT p_partkey, p_name FROM part WHERE (p_partkey BETWEEN 100 AND 150 OR p_partkey = 200 OR regexp_matches(p_name, '(?is)^.*e.* .*a.*$')) AND NOT regexp_matches(p_name, '(?is)^a.*$')")
def module_filter_glob(spark, sf_dir):
    return facts.resolve_filter(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", T.parse_ranges("100-150,200"), T.parse_list("*e* *a*"), None, [], ["a*"])


@query(f"""WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2)
SELECT n_nationkey, n_name FROM nation WHERE (n_nationkey BETWEEN 20 AND 21 OR n_nationkey IN (SELECT node FROM r)) AND NOT regexp_matches(n_name, '(?is)^.*1$')""")
def module_filter_subtree(spark, sf_dir):
    sub = graphs.reach(edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"), 2)
    return facts.resolve_filter(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", T.parse_ranges("20-21"), [], sub, [], ["*1"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_window(spark, sf_dir):
    return rows.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 100, 50)


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topn_modules(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'BLUE') OR contains(lower(p_name), lower('Re'))")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.contains_ignoring_case(F.col("p_name"), "Re")).select("p_partkey")


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN instr(reverse(substr(text, 1, 200)), chr(10)) > 0 THEN substr(text, 1, 200 - instr(reverse(substr(text, 1, 200)), chr(10))) ELSE substr(text, 1, 200) END AS kept FROM documents")
def truncate_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_at_line(F.col("text"), 200).alias("kept"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT doc_id, n, line, unnest(range(1, length(line) - 2)) AS i FROM l WHERE length(line) >= 4) WHERE substr(line, CAST(i AS BIGINT), 4) = 'anan'""")
def content_search(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.where(F.col("text").contains("anan")).select("doc_id", "line", F.explode(T.overlapping_hits(F.col("text"), "anan")).alias("pos"))


@query("SELECT doc_id, upper(substr(hex(encode(text)), 1, 16)) || ' (+' || CAST(octet_length(encode(text)) - 8 AS VARCHAR) || ')' AS preview FROM documents WHERE octet_length(encode(text)) > 8")
def hex_preview(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    shown = T.hex_preview(raw, 8)
    return table(spark, sf_dir, "documents").where(F.octet_length("text") > 8).select("doc_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, r"(?<=[0-9A-F]) (?=[0-9A-F])", ""), r" \.\.\.", ""), " bytes", "").alias("preview"))


@query("SELECT e.event_id, p.p_name FROM events e JOIN part p ON p.p_partkey = e.user_id WHERE regexp_matches(p.p_name, '^[A-Za-z_$][A-Za-z0-9_$]*$') OR regexp_matches(e.event_type, '^(click|view)$')")
def identifier_filter(spark, sf_dir):
    e, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    return e.join(p, p.p_partkey == e.user_id).where(N.is_valid_identifier(F.col("p_name")) | F.col("event_type").isin("click", "view")).select("event_id", "p_name")


# Rows


@query("SELECT l_orderkey, CAST(unnest(range(0, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT))) AS BIGINT) AS position FROM lineitem GROUP BY l_orderkey")
def rle_expand(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("n"))
    runs = runs.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n"))
    return rows.expand_runs(runs, ["l_orderkey"], "l_linenumber", "n").select("l_orderkey", "position")


@query("""SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def run_starts(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    return rows.run_starts(runs, ["l_orderkey"], "l_linenumber", "n").select("l_orderkey", "l_linenumber", "start")


@query("""SELECT a.event_id, b.event_id AS version FROM (SELECT * FROM events WHERE event_type <> 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_version(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    versions = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("version"))
    return rows.as_of(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), versions, ["user_id"], "ts", "ts", ["version"]).select("event_id", "version")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'login' OR value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS env FROM events")
def carry_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = F.when((F.col("event_type") == "login") | (F.col("value") > 50), F.col("event_id"))
    return rows.carry_forward(events, ["user_id"], ["ts", "event_id"], value, "env").select("event_id", "env")


@query("SELECT event_id, first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot FROM events")
def first_wins(spark, sf_dir):
    return rows.first_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("value") > 50, F.col("event_id")), "slot").select("event_id", "slot")


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS address FROM events")
def sleb_accumulate(spark, sf_dir):
    return rows.accumulate(table(spark, sf_dir, "events").withColumn("delta", F.floor("value")), ["user_id"], ["ts", "event_id"], "delta", "address").select("event_id", "address")


@query("""WITH m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM m WHERE event_type IN ('click', 'view'))
SELECT user_id, island, min(i) AS first, count(*) AS rows FROM s GROUP BY user_id, island HAVING count(*) >= 3""")
def islands(spark, sf_dir):
    return rows.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("click", "view"), 3).withColumn("first", F.col("first").cast("long"))


@query("""SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS block FROM (
SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 OR event_type = 'purchase' THEN 1 ELSE 0 END AS f FROM events)""")
def block_starts(spark, sf_dir):
    return rows.block_starts(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "block")


@query("SELECT l_partkey, l_orderkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def first_source_per_key(spark, sf_dir):
    return rows.first_per_key(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey", "l_suppkey"])


@query("""SELECT o.o_orderkey, count(*) AS inside FROM (SELECT l_orderkey, epoch(l_shipdate) AS t FROM lineitem) l
JOIN (SELECT o_orderkey, epoch(o_orderdate) AS s, epoch(o_orderdate) + 86400 * 30 AS e FROM orders) o ON l.l_orderkey = o.o_orderkey AND l.t >= o.s AND l.t < o.e GROUP BY o.o_orderkey""")
def exception_range(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.unix_timestamp("l_shipdate").alias("at"))
    start = F.unix_timestamp("o_orderdate")
    ranges = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("s"), (start + 86400 * 30).alias("e"))
    return rows.in_interval(points, ranges, ["o_orderkey"], "at", "s", "e", 86400 * 30).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("inside"))


# Votes and facts


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, lower(p_type) AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE NOT regexp_matches(lower(p_type), '^(r|t|arg|var|val|tmp|obj|str|num)[0-9]*$') GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY n DESC, name) AS r FROM c),
k AS (SELECT l_suppkey, l_linenumber, name, row_number() OVER (PARTITION BY l_suppkey, name ORDER BY l_linenumber) AS again FROM b WHERE r = 1)
SELECT l_suppkey, l_linenumber, CASE WHEN again = 1 THEN name ELSE name || CAST(again AS VARCHAR) END AS name FROM k""")
def vote_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("name"))
    sites = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return facts.vote_names(sites, "l_suppkey", "l_linenumber", "name")


@query("SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || CASE WHEN row_number() OVER w = 1 THEN '' ELSE CAST(row_number() OVER w AS VARCHAR) END AS unique_name FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey)")
def unique_suffix(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("base", F.concat("l_returnflag", "l_linestatus")).withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return facts.numbered(items, "l_orderkey", "o", "base").select("l_orderkey", "l_linenumber", "unique_name")


@query()
def make_unique(spark, sf_dir):
    base = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    return facts.make_unique(table(spark, sf_dir, "part").select("p_partkey", "p_brand", base.alias("base")), "p_brand", "p_partkey", "base")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name HAVING count(*) <= 30)")
def fanout_guard(spark, sf_dir):
    return facts.fan_out_guard(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 30)


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stem' || CAST(c_custkey % 400 AS VARCHAR) WHEN c_custkey % 7 = 0 THEN 'getThing' ELSE c_mktsegment END AS name, c_acctbal > 9000 AS truth FROM customer),
k AS (SELECT c_custkey, truth, CASE WHEN regexp_matches(name, '^get[A-Z]') AND NOT truth THEN NULL ELSE name END AS name FROM m),
c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY truth DESC, c_custkey) AS r FROM k)
SELECT c_custkey, CASE WHEN n <= 1 THEN name WHEN n > 4 AND NOT truth THEN NULL WHEN r = 1 THEN name END AS name FROM c""")
def finalize_stems(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("stem"), (F.col("c_custkey") % 400).cast("string"))).when(F.col("c_custkey") % 7 == 0, "getThing").otherwise(F.col("c_mktsegment"))
    return facts.finalize_stems(table(spark, sf_dir, "customer").withColumn("name", name), "c_custkey", "name", F.col("c_acctbal") > 9000)


@query("SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS children FROM nation GROUP BY n_regionkey")
def parent_children(spark, sf_dir):
    return facts.group_children(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query("SELECT source, count(*) AS n, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def fingerprint(spark, sf_dir):
    return facts.fingerprint(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS confirmed, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS rate FROM orders GROUP BY o_orderpriority")
def confirm_rate(spark, sf_dir):
    return facts.rate(table(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("SELECT l_suppkey, count(*) AS slots, count(*) FILTER (n > 1) AS split FROM (SELECT l_suppkey, l_linenumber, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber) GROUP BY l_suppkey")
def slot_census(spark, sf_dir):
    return facts.slot_census(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_returnflag")


@query("SELECT user_id, event_type, count(*) FILTER (value > 50) AS defs, count(*) FILTER (NOT value > 50) AS uses FROM events GROUP BY user_id, event_type")
def use_def_counts(spark, sf_dir):
    return facts.use_def_counts(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value") > 50)


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS props, count(*) AS uses FROM events GROUP BY user_id")
def register_facts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("props"), F.count(F.lit(1)).alias("uses"))


@query("""SELECT c_custkey AS function_id, name, role, CASE WHEN c_custkey % 50 = 49 THEN 'version' WHEN c_custkey % 50 = 48 THEN 'bundle' WHEN NOT regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN 'identifier'
WHEN name IN ('return', 'class') THEN 'reserved' WHEN s_suppkey IS NULL THEN 'no such function' WHEN NOT ((role = 'noop' AND s_acctbal > 0) OR (role = 'identity' AND s_acctbal <= 5000)) THEN 'role' ELSE 'confirmed' END AS verdict
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'return' WHEN c_custkey % 13 = 0 THEN '9x' ELSE 'fn' || CAST(c_custkey AS VARCHAR) END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'noop' ELSE 'identity' END AS role FROM customer)
LEFT JOIN supplier ON s_suppkey = c_custkey""")
def cascade_verify(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, "return").when(k % 13 == 0, "9x").otherwise(F.concat(F.lit("fn"), k.cast("string")))
    proposals = table(spark, sf_dir, "customer").select(k.alias("function_id"), name.alias("name"), F.when(k % 2 == 0, "noop").otherwise("identity").alias("role"))
    roles = F.array_compact(F.array(F.when(F.col("s_acctbal") > 0, "noop"), F.when(F.col("s_acctbal") <= 5000, "identity")))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("function_id"), roles.alias("roles"))
    return facts.verify_proposals(proposals, known, F.col("function_id") % 50 != 48, F.col("function_id") % 50 != 49)


def _secret_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    each = [f"SELECT doc_id, '{c}' AS category, '{n}' AS pattern_name, regexp_extract(text, '{quote(p)}') AS value FROM documents WHERE regexp_matches(text, '{quote(p)}')" for c, n, p in facts.SECRET_PATTERNS]
    return f"SELECT *, CASE WHEN length(value) <= 8 THEN '***' ELSE substr(value, 1, 4) || '***' || right(value, 2) END AS redacted FROM ({' UNION ALL '.join(each)})"


@query(_secret_sql())
def secrets_scan(spark, sf_dir):
    return facts.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("SELECT lang, count(*) AS texts, CAST(sum(len(regexp_extract_all(text, '\\barg[0-9]+\\b'))) AS BIGINT) AS args, CAST(sum(len(regexp_extract_all(text, '\\bclosure_[0-9]+\\b'))) AS BIGINT) AS closures, CAST(sum(len(regexp_extract_all(text, '\\btmp[0-9]*\\b'))) AS BIGINT) AS temps, CAST(sum(len(regexp_extract_all(text, '\\br[0-9]+\\b'))) AS BIGINT) AS registers, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang")
def quality_metrics(spark, sf_dir):
    return facts.quality_metrics(table(spark, sf_dir, "documents"), "lang", "text")


# Graphs


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def bfs_depth(spark, sf_dir):
    return graphs.reach(edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"), 4)


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 3 UNION SELECT 7 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def reachable(spark, sf_dir):
    return graphs.reach(edges(spark, sf_dir), spark.createDataFrame([(3,), (7,)], "node int")).select("node")


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 0 UNION SELECT dst FROM r JOIN e ON src = node) SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)")
def dead_code(spark, sf_dir):
    reached = graphs.reach(edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))
    return graphs.unreached(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), reached)


@query(f"SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS callees FROM ({EDGES}) GROUP BY src")
def callgraph_listing(spark, sf_dir):
    return graphs.adjacency(edges(spark, sf_dir), "src", "dst", "callees")


@query("""WITH p AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS child, 'n' || CAST(c_nationkey AS VARCHAR) AS parent FROM customer
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation)
SELECT child AS node, parent AS ancestor, 1 AS level FROM p UNION ALL SELECT a.child, b.parent, 2 FROM p a JOIN p b ON a.parent = b.child""")
def ancestor_chain(spark, sf_dir):
    text = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    parents = table(spark, sf_dir, "customer").select(text("c", "c_custkey").alias("child"), text("n", "c_nationkey").alias("parent"))
    parents = parents.unionByName(table(spark, sf_dir, "nation").select(text("n", "n_nationkey").alias("child"), text("r", "n_regionkey").alias("parent")))
    return graphs.ancestors(parents, "child", "parent")


def one_graph(spark, sf_dir):
    """The call graph of all line items as one bundle's, callees in id order."""
    e = edges(spark, sf_dir)
    return e.select(F.lit("nations").alias("bundle"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("dst").cast("long").alias("ordinal"))


@query()
def call_post_order(spark, sf_dir):
    return graphs.post_order(one_graph(spark, sf_dir), "bundle")


@query()
def dependency_tree(spark, sf_dir):
    return graphs.dependency_tree(one_graph(spark, sf_dir), "bundle", 0, 4)


@query()
def dominators(spark, sf_dir):
    return graphs.dominators(one_graph(spark, sf_dir), "bundle", 0)


@query()
def dominator_tree(spark, sf_dir):
    return graphs.dominator_tree(one_graph(spark, sf_dir), "bundle", 0)


@query()
def natural_loops(spark, sf_dir):
    return graphs.loops(one_graph(spark, sf_dir), "bundle", 0)


def flow(spark, sf_dir):
    """Each user's events as blocks of ten; the value tells uses from definitions; blocks follow each other, and loop back once."""
    events = table(spark, sf_dir, "events")
    w = F.row_number().over(rows.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    marked = events.select("user_id", w.alias("i"), "event_type", "value").withColumn("block", F.expr("i div 10"))
    sets = marked.groupBy("user_id", "block").agg(F.sort_array(F.collect_set(F.when(F.col("value") <= 20, F.col("event_type")))).alias("uses"), F.sort_array(F.collect_set(F.when(F.col("value") > 40, F.col("event_type")))).alias("defs"))
    last = sets.groupBy("user_id").agg(F.max("block").alias("last"))
    links = last.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("src"), "last").where("src < last").select("user_id", "src", (F.col("src") + 1).alias("dst"))
    back = last.where("last > 2").select("user_id", F.col("last").alias("src"), F.lit(1).cast("long").alias("dst"))
    return sets, links.unionByName(back)


@query()
def liveness(spark, sf_dir):
    return graphs.liveness(*flow(spark, sf_dir), "user_id")


@query()
def reaching_definitions(spark, sf_dir):
    sets, links = flow(spark, sf_dir)
    return graphs.reaching_definitions(sets.drop("uses"), links, "user_id")


@query()
def propagate_names(spark, sf_dir):
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") < 2, F.col("n_name")).alias("name"))
    return graphs.copy_names(start, edges(spark, sf_dir), N.is_generic_param)
