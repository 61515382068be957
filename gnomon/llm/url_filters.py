"""URL filters, in DataFrame operations only.

Listed rules are pairs of a host and a path.  A rule fits its host and all
subdomains where the path starts with the rule's path; the longest rule wins
(host and path together; of equal ones that with the longer host, then the
smaller in code-point order).

A URL's possible rules are the suffixes of its host, each with the prefixes of
its path that are as long as some listed path.  A blocked Bloom filter of the
listed canonical URLs passes the possible hits: the key's hash picks one block of
four 64-bit words, and two bits in each of them must be set.  A hash join with
the list itself then removes the false positives.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no rule; no rule means ``allow``; repeated rows give repeated rows; an empty
list allows all; of rules listed twice with different verdicts ``block`` wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Bits of the filter for each rule, and its most blocks (32 bytes each).
BITS = 16
MOST_BLOCKS = 1 << 20
WORDS = 4
#: Rules up to which the exact join broadcasts the list; beyond, both sides are shuffled and skewed keys split.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; empty where there is none."""
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _bloom(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits in each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [bit(12 * w).bitwiseOR(bit(12 * w + 6)) for w in range(WORDS)]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """A list of ``(host, path, verdict)`` as a DataFrame."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row of ``pages``."""
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    blocks = max(1, min(MOST_BLOCKS, 2 ** math.ceil(math.log2(max(1, size["n"] * BITS / (64 * WORDS))))))
    key = lambda h, p: F.concat(h, p)

    block, bits = _bloom(key(F.col("rule_host"), F.col("rule_path")), blocks)
    bloom = listed.select(block.alias("b"), *(x.alias(f"m{i}") for i, x in enumerate(bits))).groupBy("b").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*(F.lit(x) for x in sorted(size["lengths"]))).cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    options = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    maybe = rows.where(F.col("host") != "").select("id", "url", "host", "path", F.explode(options).alias("o")).select("id", "url", "host", "path", "o.*")
    block, bits = _bloom(key(F.col("h"), F.col("p")), blocks)
    tried = maybe.select("*", block.alias("b"), *(x.alias(f"m{i}") for i, x in enumerate(bits)))
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & (F.col(f"m{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"m{i}"))
    hits = tried.join(F.broadcast(bloom), "b").where(passes).select("id", "url", "host", "path", "h", "p")

    exact = F.broadcast(listed) if size["n"] <= BROADCAST_RULES else listed
    found = hits.join(exact, (F.col("h") == F.col("rule_host")) & (F.col("p") == F.col("rule_path")))
    best = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), F.col("rule_verdict").alias("verdict"))
    nothing = F.lit(None).cast("struct<n:int,m:int,rule:string,verdict:string>")
    both = rows.select("id", "url", "host", "path", F.lit(1).alias("own"), nothing.alias("best")).unionByName(found.select("id", "url", "host", "path", F.lit(0).alias("own"), best.alias("best")))
    judged = both.groupBy("id", "url", "host", "path").agg(F.sum("own").cast("int").alias("rows"), F.max("best").alias("best"))
    judged = judged.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP8_SQL = rf"""
WITH rules(h, p, v) AS (VALUES {_SQL_RULES}),
u AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
  FROM pages
)
SELECT u.page_id, u.host, u.path,
  arg_max(h || p, length(h) + length(p)) AS rule, coalesce(arg_max(v, length(h) + length(p)), 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY u.n, u.page_id, u.host, u.path
"""
