"""Mixing sources to target weights, in DataFrame operations only.

Words per source are summed, targets and repetition rates follow from them, and
each document is emitted ``floor(rate)`` times and once more where a number
hashed from its id and the seed is below the rate's fraction.

Targets: the budget is a share of all words, dealt to the sources by weight; no
target is over ``most`` times its source's words, and what is cut off goes to
the rest by weight until none is above.  That is a water level: with the sources
in order of the level at which each is full, the first one that the remaining
budget leaves below its brim fixes the level of all that follow.

Defined results: a null text has no words; null is a source of its own, the last
in order; a source without words has target 0 and its documents stay out; rows
that repeat an id share its draw; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import hex_number, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Sources up to which their table is broadcast; with more, the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 64


def n_words(text: str = "text") -> Column:
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", F.col("source_size") * most)
    brim = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = brim.rowsBetween(Window.unboundedPreceding, -1), brim.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("n", F.row_number().over(brim))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("n", "level"))
    rows = rows.withColumn("level", F.min(fits).over(whole)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """How often a document is taken: ``floor(rate)``, and once more by a draw hashed from its key."""
    draw = hex_number(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 13)) / F.lit(float(2**52))
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, F.lit(1)).otherwise(F.lit(0))


def with_target(rows: DataFrame, found: DataFrame, source: str = "source", limit: int = BROADCAST_SOURCES) -> DataFrame:
    """Each row with its source's size and target.

    A source table of up to ``limit`` rows is broadcast.  A larger one is joined
    with both sides salted, so that a source with a third of all rows is spread.
    """
    few = found.limit(limit + 1).count() <= limit
    right = found.withColumnRenamed("source", "__source")
    same = F.col(source).eqNullSafe(F.col("__source"))
    if few:
        return rows.join(F.broadcast(right), same).drop("__source")
    left = rows.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int"))
    right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, same & (F.col("__salt") == F.col("__salt2"))).drop("__source", "__salt", "__salt2")


def source_targets(sized: DataFrame, **options) -> DataFrame:
    """Targets for rows ``(source, size)``, kept as a table in the shared folder."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return materialize(targets(totals, **options), "mix-targets")


def rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as before."""
    found = source_targets(docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size")), **options)
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(source_col).alias("__from"), F.col(id_col).alias("__id"))
    taken = with_target(packed, found, "__from").withColumn("__n", copies(rate(), F.col("__id"), seed))
    again = taken.where(F.col("__n") > 0).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return again.select("__row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of the ``documents``."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    rows = with_target(sized, source_targets(sized))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(rate(), F.col("doc_id"))).cast("long").alias("taken"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * {MOST} AS cap FROM s
), o AS (
  SELECT *, row_number() OVER b AS n, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)
), l AS (
  SELECT *, ({SHARE}::DOUBLE * total::DOUBLE - cap_before::DOUBLE) / (all_w - w_before) AS level FROM o
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce((SELECT arg_min(level, n) FROM l WHERE level <= cap::DOUBLE / w) * w, cap::DOUBLE)) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|{SEED}'), 1, 13))::BIGINT::DOUBLE / {2.0**52!r} AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
