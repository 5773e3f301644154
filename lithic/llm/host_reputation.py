"""Empirical-Bayes reputation of hosts, with DataFrame functions only.

Labelled page outcomes are counted for each host, registered domain and suffix. The strength of each level's beta
prior is estimated by the method of moments over all its members; a member's posterior mean is the next level's
prior mean (all pages -> suffix -> registered domain -> host). A host is blocked when the lower bound of its
posterior bad rate, mean - z * sd, exceeds max_bad. URL rules come first: the longest rule that fits wins.

Defined results: a null url, or one without '://', has an empty host and path; such pages share the reputation of
the empty host. Pages without a labelled outcome still get their host's verdict, a host without any gets its
domain's mean. With no labelled outcome at all nothing is blocked by the method. Null outcomes are skipped.
Repeated pages are counted and returned once each. Extra columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a rule fits its host and all subdomains, from the start of the path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Second-level labels under which two-letter suffixes register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host with at least 1/HOT of all pages is hot; there are at most HOT of them, so they can be broadcast.
HOT = 1024


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the contract: after the first '://', host up to / ? #, path up to ? #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def best_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix); an address of digits is its own domain with an empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.+$", "")
    parts = F.split(bare, "\\.")
    n = F.size(parts)
    long = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    is_ip = bare.rlike("^[0-9.]+$|^\\[")
    keep = F.when(long, 3).otherwise(2)
    domain = F.when(is_ip | (n <= 1), bare).otherwise(F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), "."))
    suffix = F.when(is_ip | (n <= 1), F.when(is_ip, "").otherwise(bare)).otherwise(F.array_join(F.slice(parts, F.greatest(n - keep + 2, F.lit(1)), keep - 1), "."))
    return domain, suffix


def prior_strength(members: DataFrame) -> float:
    """kappa of Beta(kappa * mean, kappa * (1 - mean)) from the members' over-dispersion; one row reaches the driver."""
    m = F.greatest(F.least(F.col("prior"), F.lit(1 - 1e-6)), F.lit(1e-6))
    over = F.sum((F.col("bad") - F.col("n") * m) * (F.col("bad") - F.col("n") * m) - F.col("n") * m * (1 - m))
    scale = F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m))
    row = members.where("n > 0").agg(over.alias("over"), scale.alias("scale")).first()
    rho = (row["over"] / row["scale"]) if row and row["scale"] else 0.0
    rho = min(max(rho, 1e-4), 0.999)
    return 1 / rho - 1


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a host: pages, n labelled, bad, posterior mean and sd. pages(page_id, host), outcomes(page_id, bad 0/1)."""
    marks = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").cast("long").alias("_bad"))
    # Only pages with an id can have an outcome; the others are counted without the join.
    counted = pages.where("page_id IS NOT NULL").join(marks, F.col("page_id") == F.col("_id"), "left").select("host", "_bad")
    counted = counted.unionByName(pages.where("page_id IS NULL").select("host", F.lit(None).cast("long").alias("_bad")))
    by_host = counted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    domain, suffix = registered(F.col("host"))
    # Written once: each level's strength, the total and the result read this table of hosts, not the pages.
    hosts = cut(by_host.withColumn("domain", domain).withColumn("suffix", suffix))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(mean))
    suffixes = posterior(level, prior_strength(level)).select("suffix", F.col("mean").alias("prior"))
    level = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = posterior(level, prior_strength(level)).select("domain", "suffix", F.col("mean").alias("prior"))
    level = hosts.join(domains, ["domain", "suffix"])
    return posterior(level, prior_strength(level))


def posterior(members: DataFrame, kappa: float) -> DataFrame:
    a = F.lit(kappa) * F.col("prior") + F.col("bad")
    b = F.lit(kappa) * (1 - F.col("prior")) + (F.col("n") - F.col("bad"))
    return members.withColumn("mean", a / (a + b)).withColumn("sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, z: float = 1.645, max_bad: float = 0.25) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_rate_low for each row of pages(page_id, url)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = reputations(rows.select("page_id", "host"), outcomes).select(
        "host", "pages", F.col("mean").alias("bad_rate"), F.greatest(F.col("mean") - F.lit(z) * F.col("sd"), F.lit(0.0)).alias("bad_rate_low")
    )
    total = rows.count()
    low = F.struct("bad_rate", "bad_rate_low")
    hot = known.where(F.col("pages") * HOT >= total).limit(HOT).select(F.col("host").alias("_hot"), low.alias("_hot_rate"))
    cold = known.where(F.col("pages") * HOT < total).select(F.col("host").alias("_host"), F.lit(0).cast("long").alias("_salt"), low.alias("_cold_rate"))
    # Rows of hot hosts are answered by the broadcast; a salt of their own deals them evenly over the second join, where they match nothing.
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.abs(F.xxhash64("page_id", "path")) % 1_000_003 + 1)
    marked = rows.join(F.broadcast(hot), F.col("host") == F.col("_hot"), "left").withColumn("_s", salt)
    both = marked.join(cold, (F.col("host") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    rate = F.coalesce("_hot_rate", "_cold_rate")
    rule = best_rule(F.col("host"), F.col("path"), rules)
    low_bound = rate["bad_rate_low"]
    return both.select(
        "page_id", "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(low_bound > max_bad, "block").otherwise("allow")).alias("verdict"),
        rate["bad_rate"].alias("bad_rate"), low_bound.alias("bad_rate_low"),
    )


def oracle_sql(rules: tuple = RULES, z: float = 1.645, max_bad: float = 0.25) -> str:
    """The same verdicts by DuckDB, from pages(page_id, url) and labels(doc_id, quality)."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)

    def level(name: str, source: str) -> str:
        m = "greatest(least(prior, 1 - 1e-6), 1e-6)"
        return f"""{name}_k AS (SELECT coalesce(sum((bad - n * {m}) * (bad - n * {m}) - n * {m} * (1 - {m})) / nullif(sum(n * (n - 1) * {m} * (1 - {m})), 0), 0) AS rho FROM {source} WHERE n > 0),
{name} AS (SELECT *, (1 / least(greatest((SELECT rho FROM {name}_k), 1e-4), 0.999) - 1) AS kappa FROM {source}),
{name}_p AS (SELECT *, kappa * prior + bad AS a, kappa * (1 - prior) + (n - bad) AS b FROM {name})"""

    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT host, count(m.bad) AS n, coalesce(sum(m.bad), 0)::BIGINT AS bad FROM p LEFT JOIN m ON page_id = doc_id GROUP BY host),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS bare FROM g),
s AS (SELECT *, string_split(bare, '.') AS ps FROM b),
e AS (SELECT *, len(ps) AS np, CASE WHEN len(ps) >= 3 AND length(ps[-1]) = 2 AND ps[-2] IN ({second}) THEN 3 ELSE 2 END AS keep, regexp_matches(bare, '^[0-9.]+$|^\\[') AS ip FROM s),
hosts AS (SELECT host, n, bad, CASE WHEN ip OR np <= 1 THEN bare ELSE array_to_string(ps[greatest(np - keep + 1, 1):], '.') END AS domain,
  CASE WHEN ip THEN '' WHEN np <= 1 THEN bare ELSE array_to_string(ps[greatest(np - keep + 2, 1):], '.') END AS suffix FROM e),
l1 AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM hosts) AS prior FROM hosts GROUP BY suffix),
{level("s1", "l1")},
l2 AS (SELECT h.domain, h.suffix, sum(h.n)::BIGINT AS n, sum(h.bad)::BIGINT AS bad, any_value(q.a / (q.a + q.b)) AS prior FROM hosts h JOIN s1_p q ON h.suffix = q.suffix GROUP BY h.domain, h.suffix),
{level("s2", "l2")},
l3 AS (SELECT h.host, h.n, h.bad, q.a / (q.a + q.b) AS prior FROM hosts h JOIN s2_p q ON h.domain = q.domain AND h.suffix = q.suffix),
{level("s3", "l3")},
low AS (SELECT host, greatest(a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS low FROM s3_p),
hit AS (SELECT page_id, arg_max(h || r.path, length(h || r.path)) AS rule, arg_max(verdict, length(h || r.path)) AS verdict FROM p
  JOIN (VALUES {listed}) AS r(verdict, h, path) ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.path) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, CASE WHEN low.low > {max_bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON p.page_id = hit.page_id LEFT JOIN low ON p.host = low.host"""
