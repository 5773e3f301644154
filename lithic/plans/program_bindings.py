"""Operators over program facts bound to the driver's tables, each with the same query in SQL.

Events stand for instructions (function: user, offset: event id, registers from the value); orders, customers and
nations for a tree of closures; customers of a nation for an image, which is built, read back and asked.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import bits, hashing
from ..functions import names as N
from ..functions import text as T
from ..operators import closures, dumps, facts, graphs, program, rows
from ..operators import debug as debug_operators
from ..sources import bundles, debug, image
from .bindings import query, table

# Scalar functions


@query(r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS shown FROM documents""")
def escape_js(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_js(F.col("text")).alias("shown"))


@query(r"SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '\bring\b', 'band', 'g') AS renamed FROM part")
def whole_word(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.replace_whole_word(F.concat_ws(" ", "p_name", "p_type"), "ring", "band").alias("renamed"))


@query(r"""WITH b AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(path, '[?#].*$', ''), '\.(tsx|ts|jsx|js)$', ''), '\.(android|native|ios|web)$', ''), '/'), lambda p: p <> '') AS ps
FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '/index.ios.js' WHEN page_id % 3 = 1 THEN '.tsx' ELSE '' END AS path FROM pages))
SELECT page_id, CASE WHEN ps[-1] = 'index' AND len(ps) > 1 THEN ps[-2] ELSE ps[-1] END AS stem FROM b""")
def path_stem(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, "/index.ios.js").when(F.col("page_id") % 3 == 1, ".tsx").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", N.path_stem(F.concat("url", tail)).alias("stem"))


PROP = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_name ELSE 'default' END"


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'v' || x WHEN x IN ('default', 'new') THEN '_' || x WHEN regexp_matches(x, '^[A-Za-z_$][A-Za-z0-9_$]*$') THEN x END AS name,
CASE WHEN regexp_matches(x, '^[0-9]') OR x IN ('default', 'new') THEN '_' || x ELSE replace(x, ' ', '_') END AS clean FROM (SELECT p_partkey, {PROP} AS x FROM part)""")
def semantic_names(spark, sf_dir):
    x = F.expr(PROP.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("x")).select("p_partkey", N.semantic_identifier(F.col("x")).alias("name"), N.sanitized_identifier(F.col("x")).alias("clean"))


@query("""SELECT o_orderkey, CASE o_custkey % 8 WHEN 0 THEN 'encoder' WHEN 1 THEN 'decoder' WHEN 2 THEN 'serializer' WHEN 3 THEN 'deserializer' WHEN 4 THEN 'tokenizer' WHEN 5 THEN 'normalizer' WHEN 6 THEN 'sanitizer' END AS noun FROM orders""")
def agent_nouns(spark, sf_dir):
    methods = F.array(*[F.lit(m) for m in ("encode", "decode", "serialize", "deserialize", "tokenize", "normalize", "sanitize", "render")])
    return table(spark, sf_dir, "orders").select("o_orderkey", N.agent_noun(F.element_at(methods, (F.col("o_custkey") % 8 + 1).cast("int"))).alias("noun"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 5 THEN CAST(l_suppkey AS INTEGER) END AS argument, (l_linenumber::BIGINT << 24) | l_suppkey AS slot_key,
CASE WHEN l_linenumber > 3 THEN CAST(l_linenumber AS INTEGER) ELSE 0 END AS level, CAST(l_suppkey AS INTEGER) AS slot FROM lineitem""")
def packed_names(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    arg = F.when(F.col("l_linenumber") < 3, F.concat(F.lit("arg"), "l_suppkey")).when(F.col("l_linenumber") < 5, F.concat(F.lit("p"), "l_suppkey")).otherwise(F.concat(F.lit("q"), "l_suppkey"))
    name = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("closure_"), "l_linenumber", F.lit("_"), "l_suppkey")).otherwise(F.concat(F.lit("closure_"), "l_suppkey"))
    level, slot = N.placeholder_slot(name)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", N.argument_index(arg).alias("argument"), N.slot_key(F.col("l_linenumber"), F.col("l_suppkey")).alias("slot_key"), level.alias("level"), slot.alias("slot"))


FLAGS = " || ".join(f"CASE WHEN b & {1 << k} <> 0 THEN '{c}' ELSE '' END" for k, c in enumerate("igmusyd"))


@query(f"SELECT p_partkey, {FLAGS} AS flags FROM (SELECT p_partkey, p_partkey % 128 AS b FROM part)")
def regexp_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.regex_flags(F.col("p_partkey") % 128).alias("flags"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size
FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)""")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * F.col("o_custkey")).alias("size"))


@query("SELECT doc_id, sha256(text) AS key, doc_id % 2 = 0 AS sealed FROM documents WHERE text IS NOT NULL")
def file_keys(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    footer = F.unhex(F.when(F.col("doc_id") % 2 == 0, F.sha1(raw)).otherwise(F.sha1(F.lit("other"))))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", hashing.file_key(raw).alias("key"), hashing.footer_ok(F.concat(raw, footer)).alias("sealed"))


@query("""SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)),
lambda h, c: xor((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295, ((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295) >> 6)) AS hash FROM part""")
def identifier_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.identifier_hash(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey, substr(p_name, least(p_size, length(p_name)) + 1, greatest(least(p_size + 4, length(p_name)) - least(p_size, length(p_name)), 0)) AS part FROM part")
def storage_slice(spark, sf_dir):
    raw = F.encode("p_name", "UTF-8")
    return table(spark, sf_dir, "part").select("p_partkey", F.decode(dumps.slice_of(raw, F.col("p_size"), F.col("p_size") + 4), "UTF-8").alias("part"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) >= 4 THEN unicode(substr(p_name, 1, 1)) + 256 * unicode(substr(p_name, 2, 1)) + 65536 * unicode(substr(p_name, 3, 1)) + 16777216::BIGINT * unicode(substr(p_name, 4, 1)) END AS word,
raw & 1 = 1 AS wide, (raw >> 1) & 8388607 AS start, (raw >> 24) & 255 AS length, raw & 2 = 2 AS resolved, CASE WHEN p_size < 98 - 60 THEN raw & 4 = 4 END AS has_async
FROM (SELECT *, p_partkey::BIGINT * 2654435 AS raw FROM part)""")
def image_bits(spark, sf_dir):
    raw, part = F.col("p_partkey").cast("long") * 2654435, table(spark, sf_dir, "part")
    wide, start, length = bits.small_string(raw)
    _, resolved, has_async = bits.options(raw, F.col("p_size") + 60)
    return part.select("p_partkey", bits.unsigned(F.encode("p_name", "UTF-8"), 0, 4).alias("word"), wide.alias("wide"), start.alias("start"), length.alias("length"), resolved.alias("resolved"), has_async.alias("has_async"))


@query("SELECT p_partkey, p_name || ' a  b' AS text FROM part")
def strip_comments(spark, sf_dir):
    marked = F.concat("p_name", F.lit("/* "), "p_partkey", F.lit(" */ a /* 7 */ b"))
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_id_comments(marked).alias("text"))


# Instructions


def stream(spark, sf_dir):
    """Signups write closures, clicks copy registers, purchases load numbers, views call."""
    v = F.floor("value").cast("long")
    op = lambda ty, c: F.struct(F.lit(ty).alias("ty"), c.cast("long").alias("val_i"), F.lit(None).cast("double").alias("val_f"))
    kind = F.col("event_type")
    name = F.when(kind == "signup", "CreateClosure").when(kind == "click", "Mov").when(kind == "purchase", "LoadConstInt").when(kind == "view", "Call1").otherwise("Nop")
    register = op("Reg8", v % 4)
    operands = (
        F.when(kind == "signup", F.array(register, op("Reg8", F.lit(0)), op("UInt16", v)))
        .when(kind == "click", F.array(register, op("Reg8", F.floor(v / 4) % 4)))
        .when(kind == "purchase", F.array(register, op("Imm32", v)))
        .when(kind == "view", F.array(op("Reg8", F.lit(9)), register))
        .otherwise(F.array().cast("array<struct<ty:string,val_i:bigint,val_f:double>>"))
    )
    return table(spark, sf_dir, "events").select(F.lit("b").alias("bundle_id"), F.col("user_id").alias("function_id"), F.col("event_id").alias("offset"), name.alias("name"), operands.alias("operands"))


STREAM = """i AS (SELECT user_id AS f, event_id AS o, event_type AS t, CAST(floor(value) AS BIGINT) AS v FROM events),
d AS (SELECT f, v % 4 AS r, o, t, v FROM i WHERE t IN ('signup', 'click', 'purchase')),
q0 AS (SELECT f, o AS call, v % 4 AS r, o AS at FROM i WHERE t = 'view')"""
STEPS = ",\n".join(
    f"s{k} AS (SELECT q.f, q.call, d.o, d.t, d.v FROM q{k} q ASOF JOIN d ON q.f = d.f AND q.r = d.r AND q.at > d.o), q{k + 1} AS (SELECT f, call, (v // 4) % 4 AS r, o AS at FROM s{k} WHERE t = 'click')" for k in range(4)
)


@query(f"WITH {STREAM},\n{STEPS}\nSELECT f AS caller, call AS \"offset\", v AS callee FROM ({' UNION ALL '.join(f'FROM s{k}' for k in range(4))}) WHERE t = 'signup'")
def call_edges(spark, sf_dir):
    return program.call_edges(stream(spark, sf_dir)).select("caller", "offset", "callee")


@query(f"WITH {STREAM}\nSELECT q.f AS function_id, q.call AS \"offset\", d.o AS definition FROM q0 q ASOF LEFT JOIN d ON q.f = d.f AND q.r = d.r AND q.at > d.o")
def register_definition(spark, sf_dir):
    code = stream(spark, sf_dir)
    reads = code.where("name = 'Call1'").select("bundle_id", "function_id", program.operand(1).alias("register"), F.col("offset").alias("at"))
    return program.held_at(reads, program.definitions(code)).select("function_id", F.col("at").alias("offset"), F.col("def.offset").alias("definition"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup FROM events")
def last_definition(spark, sf_dir):
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return program.last_definition(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], value, "signup").select("event_id", "signup")


@query("""SELECT user_id AS function_id, CAST(floor(value) AS BIGINT) % 5 AS param, arg_min(event_type, CASE WHEN event_type IN ('signup', 'purchase') THEN 0 ELSE 1 END * 1000000000000 + event_id) AS name FROM events GROUP BY 1, 2""")
def param_hints(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "semantic").otherwise("type")
    hints = table(spark, sf_dir, "events").select(F.lit("b").alias("bundle_id"), F.col("user_id").alias("function_id"), (F.floor("value") % 5).alias("param"), kind.alias("kind"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("name"))
    return program.param_hints(hints).select("function_id", "param", "name")


@query("SELECT DISTINCT p_partkey AS function_id, 'first' AS param, replace(lower(p_type || ' ' || p_name), ' ', ',') AS words FROM part WHERE p_size <= 25")
def error_hints(spark, sf_dir):
    params = F.when(F.col("p_size") > 25, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array(F.lit("first"), F.lit("first")))
    throws = table(spark, sf_dir, "part").select(F.lit("b").alias("bundle_id"), F.col("p_partkey").alias("function_id"), params.alias("params"), F.concat("p_type", F.lit(": "), "p_name", F.lit("!")).alias("message"))
    return program.error_hints(throws).select("function_id", "param", F.array_join("words", ",").alias("words"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN min(l_partkey) = max(l_partkey) THEN min(l_partkey) END AS l_partkey, min(l_partkey) <> max(l_partkey) AS many FROM lineitem GROUP BY l_orderkey, l_linenumber")
def reaching_bindings(spark, sf_dir):
    return program.reaching_binding(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


@query("""WITH w AS (SELECT o_orderpriority AS bundle, o_orderkey * 400009 AS id, min(o_orderdate) AS d, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT bundle, id, CASE WHEN id >= 4026531840 THEN 4026531840 + row_number() OVER (PARTITION BY bundle, id >= 4026531840 ORDER BY d, k) - 1 ELSE id END AS dense_id FROM w""")
def wide_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bundle"), (F.col("o_orderkey") * 400009).alias("id"), "o_orderdate", "o_orderkey")
    return program.interned(ids, "bundle", "id", ["o_orderdate", "o_orderkey"])


@query("SELECT l_suppkey, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY r) AS sample FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 8 GROUP BY l_suppkey")
def first_samples(spark, sf_dir):
    found = program.samples(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_orderkey")
    return found.select("l_suppkey", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query("SELECT c_custkey AS function_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY 1 LIMIT 200")
def dead_report(spark, sf_dir):
    """The report names the first 200 functions that no urgent order calls."""
    called = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    dead = table(spark, sf_dir, "customer").join(called, "c_custkey", "left_anti").select(F.col("c_custkey").alias("function_id"))
    return program.capped(dead, ["function_id"], 200)


@query("SELECT module_id, label FROM (SELECT p_partkey AS module_id, CASE WHEN p_size > 25 THEN 'module_' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS label FROM part) WHERE contains(lower(label), 'e_1') OR contains(lower(label), 'e_1')")
def module_rows(spark, sf_dir):
    modules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module_id"), F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name")).alias("name"))
    return program.module_rows(modules, "E_1").select("module_id", "label")


# Closures


def tree(spark, sf_dir):
    """closure_parents: orders in customers in nations; ids are dealt apart."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    up = c.select((F.col("c_custkey") + 1_000_000).cast("long").alias("child"), F.col("c_nationkey").cast("long").alias("parent"))
    return up.unionByName(o.select((F.col("o_orderkey") + 1_000_000_000).cast("long").alias("child"), (F.col("o_custkey") + 1_000_000).cast("long").alias("parent"))).withColumn("bundle_id", F.lit("b"))


def bodies(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit("b").alias("bundle_id"), (F.col("o_orderkey") + 1_000_000_000).cast("long").alias("function_id"))


def factories(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return nation.select(F.lit("b").alias("bundle_id"), F.col("n_nationkey").cast("long").alias("function_id"), (F.col("n_nationkey") * 10).cast("long").alias("module_id"))


NEST = "SELECT o_orderkey + 1000000000 AS function_id, c_custkey, n_nationkey, n_regionkey, n_name, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT function_id, CASE WHEN n_regionkey < 3 THEN n_nationkey::BIGINT * 10 END AS module_id FROM ({NEST})")
def module_of_function(spark, sf_dir):
    return closures.module_of(bodies(spark, sf_dir), factories(spark, sf_dir), tree(spark, sf_dir)).select("function_id", "module_id")


@query(f"SELECT DISTINCT function_id FROM ({NEST}) WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3 AND contains(n_name, '1'))")
def selected_functions(spark, sf_dir):
    """Functions of the modules that a filter chose; orphans are in none."""
    parents, own = tree(spark, sf_dir), bodies(spark, sf_dir)
    chosen = factories(spark, sf_dir).join(table(spark, sf_dir, "nation").where("n_name LIKE '%1%'").select(F.col("n_nationkey").cast("long").alias("function_id")), "function_id", "left_semi")
    return program.selected_functions(own, None, closures.module_of(own, factories(spark, sf_dir), parents), chosen).select("function_id").distinct()


@query(f"""SELECT c_custkey + 1000000 AS function_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS names FROM ({NEST}) GROUP BY c_custkey
UNION ALL SELECT n_nationkey::BIGINT, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM ({NEST}) GROUP BY n_nationkey""")
def captured_names(spark, sf_dir):
    uses = table(spark, sf_dir, "orders").select(F.lit("b").alias("bundle_id"), (F.col("o_orderkey") + 1_000_000_000).cast("long").alias("function_id"), F.col("o_orderpriority").alias("name"))
    return closures.captured(uses, tree(spark, sf_dir)).select("function_id", "names")


def held_slots(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("function_id"), F.col("n_regionkey").cast("long").alias("slot"), F.col("n_name").alias("value"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).cast("long").alias("function_id"), (F.col("c_custkey") % 3).cast("long").alias("slot"), F.col("c_mktsegment").alias("value"))
    return n.unionByName(c).select(F.lit("b").alias("bundle_id"), "function_id", F.lit(0).alias("level"), "slot", F.lit("v").alias("kind"), "value")


@query(f"""SELECT n_nationkey::BIGINT AS function_id, n_regionkey::BIGINT AS key, n_name AS value FROM nation
UNION ALL SELECT c_custkey + 1000000, c_custkey % 3, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, (1 << 24) | n_regionkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT function_id, (1 << 24) | (c_custkey % 3), c_mktsegment FROM ({NEST})
UNION ALL SELECT function_id, (2 << 24) | n_regionkey, n_name FROM ({NEST})""")
def slot_view(spark, sf_dir):
    return closures.slot_view(held_slots(spark, sf_dir), tree(spark, sf_dir)).select("function_id", "key", "value")


@query(f"SELECT function_id, 'closure_1_' || CAST(c_custkey % 3 AS VARCHAR) AS name, c_mktsegment AS resolved FROM ({NEST}) UNION ALL SELECT function_id, 'closure_5_0', 'closure_5_0' FROM ({NEST})")
def slot_owner(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = o.select(F.lit("b").alias("bundle_id"), (F.col("o_orderkey") + 1_000_000_000).cast("long").alias("function_id"), F.explode(F.array(F.concat(F.lit("closure_1_"), (F.col("o_custkey") % 3).cast("string")), F.lit("closure_5_0"))).alias("name"))
    return closures.resolve_placeholders(own, closures.slot_view(held_slots(spark, sf_dir), tree(spark, sf_dir))).select("function_id", "name", "resolved")


@query(f"SELECT DISTINCT function_id, CAST(c_custkey + 1000000 AS VARCHAR) || ',' || CAST(n_nationkey AS VARCHAR) AS chain, 0::BIGINT AS own, 2::BIGINT AS seen FROM ({NEST}) UNION ALL SELECT c_custkey + 1000000, CAST(c_nationkey AS VARCHAR), 1, 2 FROM customer")
def cache_query(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("b").alias("bundle_id"), (F.col("c_custkey") + 1_000_000).cast("long").alias("function_id"))
    found = program.cache_answer(bodies(spark, sf_dir).unionByName(c), tree(spark, sf_dir), held_slots(spark, sf_dir))
    return found.select("function_id", "chain", F.col("own").cast("long").alias("own"), F.col("seen").cast("long").alias("seen"))


@query("SELECT n_nationkey::BIGINT * 10 AS module_id, n_nationkey::BIGINT AS function_id FROM nation WHERE n_regionkey < 3")
def module_functions(spark, sf_dir):
    """Functions that no other contains, under their modules."""
    own = table(spark, sf_dir, "nation").select(F.lit("b").alias("bundle_id"), F.col("n_nationkey").cast("long").alias("function_id")).unionByName(bodies(spark, sf_dir))
    parents = tree(spark, sf_dir)
    grouped, _ = program.grouped_by_module(own, closures.module_of(own, factories(spark, sf_dir), parents), parents)
    return grouped.select("module_id", "function_id")


@query("SELECT p_partkey AS function_id, CASE WHEN p_size < 10 THEN 'f' || CAST(p_size AS VARCHAR) ELSE p_name END AS name, p_size < 10 AS changed FROM part")
def cascade_apply(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function_id"), F.col("p_name").alias("name"), "p_size")
    verdicts = part.select("function_id", F.concat(F.lit("f"), "p_size").alias("name"), F.when(F.col("p_size") < 10, "confirmed").otherwise("rejected").alias("verdict"))
    return closures.apply_names(part.drop("p_size"), verdicts).select("function_id", "name", "changed")


@query("SELECT o_custkey AS module_id, min(o_orderpriority) AS name FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
def single_export(spark, sf_dir):
    exported = table(spark, sf_dir, "orders").select(F.lit("b").alias("bundle_id"), F.col("o_custkey").alias("module_id"), F.when(F.col("o_orderpriority") == "5-LOW", "default").otherwise(F.regexp_replace("o_orderpriority", " ", "")).alias("export_name"))
    named = closures.name_from_single_export(exported)
    return named.select("module_id", F.regexp_replace("name", "NOTSPECIFIED", "NOT SPECIFIED").alias("name"))


# Images


OPCODES = {1: ("LoadConstInt", ["Reg8", "Imm32"]), 2: ("Ret", ["Reg8"])}
VERSIONS = (84, 94, 98, 99)


def images(spark, sf_dir):
    """path, content: an image for each nation, of a version of its own, with a function for each customer."""

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("c_custkey")
        nation = int(own["c_nationkey"].iloc[0])
        strings = [*own["c_name"], f"long {nation} " + "x" * 300, f"é{nation}"]
        functions = [
            {"body": image.encode_body([(1, [k % 200, k]), (2, [k % 200])], OPCODES), "name_id": i, "param_count": k % 7 + 1, "frame_size": k, "flags": (k % 2) * 4 + k % 3}
            for i, k in enumerate(map(int, own["c_custkey"]))
        ]
        data = image.build(VERSIONS[nation % 4], strings, functions, handlers={0: [(0, 6, 6)]}, options_raw=nation % 8)
        return pd.DataFrame({"path": [f"n{nation}"], "content": [data]})

    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return customers.groupBy("c_nationkey").applyInPandas(build, "path string, content binary")


def opcode_rows(spark):
    return spark.createDataFrame([(84, 1, "LoadConstInt", ["Reg8", "Imm32"], False), (84, 2, "Ret", ["Reg8"], False)], "version int, opcode int, name string, operand_types array<string>, is_jump boolean")


NTH = "SELECT *, 'n' || CAST(c_nationkey AS VARCHAR) AS bundle_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer"


@query("""SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS bundle_id, CASE c_nationkey % 4 WHEN 0 THEN 84 WHEN 1 THEN 94 WHEN 2 THEN 98 ELSE 99 END AS version, CASE c_nationkey % 4 WHEN 0 THEN 84 WHEN 1 THEN 94 WHEN 2 THEN 98 ELSE 99 END AS peeked,
CASE WHEN c_nationkey % 4 < 2 THEN 'legacy' ELSE 'modern' END AS layout, count(*) AS function_count, count(*) + 2 AS string_count, CASE WHEN c_nationkey % 4 < 2 THEN (c_nationkey & 4) = 4 END AS has_async, true AS clean, true AS sealed FROM customer GROUP BY c_nationkey""")
def image_bundles(spark, sf_dir):
    files = images(spark, sf_dir)
    peeked = files.select(F.col("path").alias("bundle_id"), bundles.peeked_version().alias("peeked"), hashing.footer_ok(F.col("content")).alias("sealed"))
    found = bundles.facts(files, "bundles")
    return found.join(peeked, "bundle_id").join(dumps.is_clean(found), "bundle_id").select("bundle_id", "version", "peeked", "layout", "function_count", "string_count", "has_async", "clean", "sealed")


@query(f"SELECT bundle_id, nth AS function_id, c_name AS name, c_custkey % 7 + 1 AS param_count, c_custkey AS frame_size, 8::BIGINT AS size, c_custkey % 2 = 1 AS is_strict, c_custkey % 3 = 1 AS prohibit_construct FROM ({NTH})")
def image_functions(spark, sf_dir):
    files = images(spark, sf_dir)
    functions = bundles.facts(files, "functions")
    named = dumps.dump_functions(functions, bundles.facts(files, "strings"))
    return named.join(functions.select("bundle_id", "function_id", "is_strict", "prohibit_construct"), ["bundle_id", "function_id"]).drop("offset")


@query(f"""SELECT bundle_id, nth AS string_id, c_name AS value, 'identifier' AS kind, false AS is_utf16 FROM ({NTH})
UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), count(*), 'long ' || CAST(c_nationkey AS VARCHAR) || ' ' || repeat('x', 300), 'identifier', false FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), count(*) + 1, 'é' || CAST(c_nationkey AS VARCHAR), 'identifier', true FROM customer GROUP BY c_nationkey""")
def image_strings(spark, sf_dir):
    return dumps.dump_strings(bundles.facts(images(spark, sf_dir), "strings"))


@query(f"""SELECT bundle_id, nth AS function_id, 0::BIGINT AS "offset", 'LoadConstInt' AS name, 6 AS length, CAST(c_custkey % 200 AS VARCHAR) || ',' || CAST(c_custkey AS VARCHAR) AS operands FROM ({NTH})
UNION ALL SELECT bundle_id, nth, 6, 'Ret', 2, CAST(c_custkey % 200 AS VARCHAR) FROM ({NTH})""")
def image_instructions(spark, sf_dir):
    code = bundles.instructions(bundles.facts(images(spark, sf_dir), "bodies"), opcode_rows(spark))
    return code.select("bundle_id", "function_id", "offset", "name", "length", F.array_join(F.transform("operands", lambda o: o["val_i"].cast("string")), ",").alias("operands"))


@query(f"SELECT bundle_id, nth AS function_id, '  LoadConstInt r' || CAST(c_custkey % 200 AS VARCHAR) || ', ' || CAST(c_custkey AS VARCHAR) || chr(10) || '  Ret r' || CAST(c_custkey % 200 AS VARCHAR) AS text FROM ({NTH})")
def image_disassembly(spark, sf_dir):
    files = images(spark, sf_dir)
    return dumps.disassembly(bundles.instructions(bundles.facts(files, "bodies"), opcode_rows(spark)), bundles.facts(files, "strings"))


@query("SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS bundle_id, 0::BIGINT AS function_id, 0 AS ordinal, 0::BIGINT AS start, 6::BIGINT AS \"end\", 6::BIGINT AS target FROM customer GROUP BY c_nationkey")
def image_handlers(spark, sf_dir):
    return bundles.facts(images(spark, sf_dir), "exception_handlers")


@query("""SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS bundle_id, s.name, CASE s.k WHEN 0 THEN count(*) * CASE WHEN c_nationkey % 4 < 2 THEN 16 ELSE 12 END WHEN 1 THEN 4 WHEN 2 THEN (count(*) + 2) * 4 ELSE 8 END AS size,
CASE s.k WHEN 0 THEN count(*) WHEN 2 THEN count(*) + 2 ELSE 1 END AS entries
FROM customer, (VALUES ('function_headers', 0), ('string_kinds', 1), ('small_string_table', 2), ('overflow_string_table', 3)) AS s(name, k) GROUP BY c_nationkey, s.name, s.k""")
def image_sections(spark, sf_dir):
    found = bundles.facts(images(spark, sf_dir), "sections")
    return found.where(F.col("name").isin("function_headers", "string_kinds", "small_string_table", "overflow_string_table")).select("bundle_id", "name", "size", "entries")


@query(f"SELECT bundle_id, nth AS function_id, 6::BIGINT AS body_offset FROM ({NTH})")
def image_offset(spark, sf_dir):
    functions = bundles.facts(images(spark, sf_dir), "functions")
    spots = functions.select("bundle_id", (F.col("offset") + 6).alias("at"))
    return dumps.at_file_offset(functions, spots).select("bundle_id", "function_id", "body_offset")


@query(f"""SELECT bundle_id, nth AS function_id, c_name || ' params=' || CAST(c_custkey % 7 + 1 AS VARCHAR) || ' frame=' || CAST(c_custkey AS VARCHAR) || ' regs=' || CAST(c_custkey + c_custkey % 7 + 1 AS VARCHAR) || ' size=8 handlers=' || CASE WHEN nth = 0 THEN '1' ELSE '0' END AS info FROM ({NTH})""")
def image_banner(spark, sf_dir):
    files = images(spark, sf_dir)
    line = dumps.banner(bundles.facts(files, "functions"), bundles.facts(files, "strings"), bundles.facts(files, "exception_handlers"))
    return line.select("bundle_id", "function_id", F.regexp_replace("info", " (offset=[0-9]+|flags=[a-z,-]*)", "").alias("info"))


@query("SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS bundle_id, 84 AS table_version, CASE c_nationkey % 4 WHEN 0 THEN 84 WHEN 1 THEN 94 WHEN 2 THEN 98 ELSE 99 END AS version FROM customer GROUP BY c_nationkey")
def image_tables(spark, sf_dir):
    return bundles.table_version(bundles.facts(images(spark, sf_dir), "bundles"), opcode_rows(spark)).select("bundle_id", "table_version", "version")


@query("SELECT o_custkey AS scope, string_agg(name, ',' ORDER BY o_orderkey) AS names FROM (SELECT o_custkey, o_orderkey, o_orderstatus || CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1 THEN '' ELSE CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS VARCHAR) END AS name FROM orders) GROUP BY o_custkey")
def allocated_names(spark, sf_dir):
    given = facts.make_unique(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus")
    return given.groupBy(F.col("o_custkey").alias("scope")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "unique_name"))), lambda x: x["unique_name"]), ",").alias("names"))


@query("SELECT DISTINCT CAST(floor(value) AS BIGINT) AS version FROM events ORDER BY 1")
def versions_list(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.floor("value").alias("version")).distinct().orderBy("version")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def run_lengths(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1))
    return rows.expand_runs(runs.select("l_orderkey", "l_linenumber", "one"), ["l_orderkey"], "l_linenumber", "one").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'react-native' WHEN 1 THEN replace(p_name, ' ', '-') ELSE '@scope/' || p_name || '.' || CAST(p_size AS VARCHAR) END AS last FROM part),
w AS (SELECT p_partkey, string_split(replace(replace(regexp_extract(last, '[^/]*$'), '-', ' '), '.', ' '), ' ') AS ws FROM m)
SELECT p_partkey, CASE WHEN name NOT IN ('new', 'default') THEN name END AS name FROM (SELECT p_partkey, array_to_string(list_prepend(ws[1], list_transform(ws[2:], lambda x: upper(x[1]) || x[2:])), '') AS name FROM w)""")
def import_names(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 3 == 0, "react-native").when(F.col("p_partkey") % 3 == 1, F.regexp_replace("p_name", " ", "-")).otherwise(F.concat(F.lit("@scope/"), "p_name", F.lit("."), "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", N.import_name(path).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 3 THEN split_part(p_name, ' ', 1) END AS name FROM part""")
def constant_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    shown = F.when(k == 0, F.concat(F.lit('"'), F.regexp_replace("p_name", " ", "_"), F.lit('"'))).when(k == 1, F.col("p_size").cast("string")).when(k == 2, F.lit("'require'")).otherwise(F.concat(F.lit(" '"), F.split("p_name", " ")[0], F.lit("' ")))
    return table(spark, sf_dir, "part").select("p_partkey", N.constant_name(shown).alias("name"))


@query("""SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 3, 4) AS generic FROM part""")
def generic_modules(spark, sf_dir):
    names = F.array(F.lit("obj129"), F.concat(F.lit("tmp"), "p_size"), F.lit("get thing"), F.concat(F.lit("importDefaultResult"), "p_size"), F.concat(F.lit("_default"), "p_size"), F.lit("settings"), F.lit("arrow"), F.concat(F.lit("Screen"), "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", N.is_generic_module(F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("generic"))


# Debug sections

DEBUG_VERSIONS = (84, 96, 98, 99)


def debug_images(spark, sf_dir):
    """path, content: an image for each customer, a function for each order, a location for each line number of an order."""

    def built(customer: int, orders: list[dict]) -> bytes:
        version, streams, scopes, scope_of, callees = DEBUG_VERSIONS[customer % 4], {}, [(None, 0, ["root"])], {}, {}
        for k, o in enumerate(orders):
            order = o["o_orderkey"]
            streams[k] = [(0, order % 100, 0), *((p["l_linenumber"] * 3, p["supplier"] % 500, p["n"]) for p in o["points"] or ())]
            if order % 3:
                scope_of[k] = len(scopes)
                scopes.append((0, order % 4, [o["o_orderpriority"], "", f"s{order % 50}"]))
            else:
                callees[order] = f"f{order % 7}"
        functions = [{"body": image.encode_body([(2, [0])], OPCODES), "name_id": 0} for _ in orders]
        return image.build(version, ["f"], functions, handlers={0: [(0, 2, 2)]}, debug=debug.build(version, streams, scopes, scope_of, callees))

    def run(batches):
        for rows_ in bundles.pieces(batches):
            yield pa.RecordBatch.from_pydict({"path": [f"c{r['o_custkey']}" for r in rows_], "content": pa.array([built(r["o_custkey"], r["orders"]) for r in rows_], pa.binary())})

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("supplier"), F.count(F.lit(1)).alias("n"))
    points = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "supplier", "n"))).alias("points"))
    orders = table(spark, sf_dir, "orders").join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    whole = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "points"))).alias("orders"))
    spread = whole.repartition(spark.sparkContext.defaultParallelism, "o_custkey")  # few bytes, much work: more tasks than the sizes call for
    return graphs.settle(spread.mapInArrow(run, "path string, content binary"))


NTH_ORDER = "SELECT *, 'c' || CAST(o_custkey AS VARCHAR) AS bundle_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders"
OLD_ORDER = f"SELECT * FROM ({NTH_ORDER}) WHERE o_custkey % 4 < 2 AND o_orderkey % 3 <> 0"
POINTS = f"""points AS (SELECT bundle_id, nth, 0 AS place, o_orderkey % 100 AS line, 0::BIGINT AS "column" FROM ({NTH_ORDER})
UNION ALL SELECT bundle_id, nth, l_linenumber * 3, min(l_suppkey) % 500, count(*) FROM ({NTH_ORDER}) JOIN lineitem ON l_orderkey = o_orderkey GROUP BY bundle_id, nth, l_linenumber)"""


@query(f"""WITH {POINTS} SELECT bundle_id, nth AS function_id, CAST(row_number() OVER (PARTITION BY bundle_id, nth ORDER BY place) - 1 AS INTEGER) AS ordinal, place::BIGINT AS bytecode_offset, line, "column" FROM points""")
def debug_locations(spark, sf_dir):
    return bundles.facts(debug_images(spark, sf_dir), "debug_locations").drop("scope_offset")


@query(f"""SELECT bundle_id, nth AS function_id, r::INTEGER AS register, CASE r WHEN 0 THEN o_orderpriority ELSE 's' || CAST(o_orderkey % 50 AS VARCHAR) END AS name FROM ({OLD_ORDER}), (VALUES (0), (2)) AS v(r)""")
def debug_variables(spark, sf_dir):
    files = debug_images(spark, sf_dir)
    return debug_operators.variable_map(bundles.facts(files, "function_scopes"), bundles.facts(files, "scopes"))


@query(f"""WITH named AS (SELECT bundle_id, o_orderpriority AS name FROM ({OLD_ORDER}) UNION ALL SELECT bundle_id, 's' || CAST(o_orderkey % 50 AS VARCHAR) FROM ({OLD_ORDER})
UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'root' FROM orders WHERE o_custkey % 4 < 2 GROUP BY o_custkey)
SELECT bundle_id, 'vars' AS kind, NULL::BIGINT AS place, name AS text FROM named GROUP BY bundle_id, name
UNION ALL SELECT bundle_id, 'callees', o_orderkey, 'f' || CAST(o_orderkey % 7 AS VARCHAR) FROM ({NTH_ORDER}) WHERE o_custkey % 4 < 2 AND o_orderkey % 3 = 0""")
def debug_listing(spark, sf_dir):
    files = debug_images(spark, sf_dir)
    return debug_operators.listing(bundles.facts(files, "scopes"), bundles.facts(files, "callees"), "vars", "callees")


@query(f"""WITH {POINTS}, asked AS (SELECT bundle_id, nth, step * 5 AS "offset" FROM ({NTH_ORDER}), (VALUES (0), (1), (2), (3)) AS v(step))
SELECT a.bundle_id, a.nth AS function_id, a."offset"::BIGINT AS "offset", p.line, p."column" FROM asked a ASOF JOIN points p ON a.bundle_id = p.bundle_id AND a.nth = p.nth AND a."offset" >= p.place""")
def debug_lines(spark, sf_dir):
    files = debug_images(spark, sf_dir)
    asked = bundles.facts(files, "functions").select("bundle_id", "function_id", F.explode(F.array(*[F.lit(5 * k).cast("long") for k in range(4)])).alias("offset"))
    return debug_operators.located(asked, bundles.facts(files, "debug_locations"))
