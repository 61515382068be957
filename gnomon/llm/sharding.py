"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

A topology is a list of leaves ``(shard, region, rack, weight)``.  A document
descends from region to rack to shard.  At every level each child draws
``-ln(u) / weight`` with a uniform ``u`` hashed from the document's id and the
child's name, and the smallest draw wins, which happens to each child in
proportion to its weight.  A draw depends on nothing else, so when a subtree's
weight grows, only documents that now choose this subtree move; if it shrinks,
only documents inside it do.  A shard added as a region of its own takes
documents only into itself.

Slots number the documents of a shard without gaps.  No task ever holds a whole
shard: documents are ordered inside blocks of their shard, hashed from the id and
the text's check sum (so that rows of one id, as all without one, spread), and a
table with one count per shard and block says where each block starts.

Defined results: a null id is a key like any other; a null text has no bytes
and the check sum of the empty text; repeated rows share the shard and get slots
of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import hex_number, table, text_or_empty

SHARDS = 24
#: Blocks of each shard whose rows are ordered by one task.
BLOCKS = 1024
#: Rows of the table of blocks' first slots up to which it is broadcast.
BROADCAST_STARTS = 1_000_000
#: Bytes that each row counts besides its text.
ROW_BYTES = 8


class Leaf(NamedTuple):
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, base: int = SHARDS, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """The tree for a number of shards.

    The first ``base`` shards fill racks of ``per_rack`` in regions of ``racks``;
    each later one is a region of its own, so that growth by one shard changes
    the weight of no older subtree.
    """
    out = []
    for s in range(shards):
        rack = s // per_rack
        out.append(Leaf(s, f"r{rack // racks}", f"k{rack}") if s < base else Leaf(s, f"grown{s}", f"grown{s}"))
    return out


def _draw(key: Column, node: str, weight: float) -> Column:
    uniform = (hex_number(F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, 13)).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.ln(uniform) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; equal draws go to the first child."""
    if len(children) == 1:
        return children[0][2]
    return F.array_min(F.array(*(F.struct(_draw(key, node, w).alias("d"), F.lit(i).alias("i")) for i, (node, w, _) in enumerate(children)))).getField("i")


def assign(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a string key: one weighted draw at each level of the tree."""
    leaves = [x for x in leaves if x.weight > 0]

    def below(level: int, part: list[Leaf], path: str) -> Column:
        if level == 3:
            return F.lit(part[0].shard)
        names: dict[str, list[Leaf]] = {}
        for x in part:
            names.setdefault((x.region, x.rack, str(x.shard))[level], []).append(x)
        if len(names) == 1:
            return below(level + 1, part, f"{path}/{next(iter(names))}")
        pick = _winner(key, [(f"{path}/{n}", sum(x.weight for x in xs), F.lit(0)) for n, xs in names.items()])
        if level == 2:
            return F.element_at(F.array(*(F.lit(xs[0].shard) for xs in names.values())), pick + 1)
        out = None
        for i, (n, xs) in enumerate(names.items()):
            deeper = below(level + 1, xs, f"{path}/{n}")
            out = F.when(pick == i, deeper) if out is None else out.when(pick == i, deeper)
        return out

    return below(0, leaves, "")


def shard_documents(
    docs: DataFrame,
    leaves: list[Leaf],
    grown: list[Leaf] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int = BLOCKS,
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot, grown_shard)`` of every row.

    The texts are read once; where each row goes (a few numbers) is a table in the
    shared folder, from which blocks are counted and slots are dealt.  The only
    broadcast table has one row per shard and block, at most ``len(leaves) * blocks``;
    beyond ``BROADCAST_STARTS`` rows it is joined by a shuffle.
    """
    key = F.coalesce(F.col("__id").cast("string"), F.lit("null"))
    block = hex_number(F.substring(F.md5(F.concat(key, F.lit("|"), F.col("crc").cast("string"), F.lit("|block"))), 1, 8)) % blocks
    full = docs.select(F.col(id_col).alias("__id"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n"), F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"))
    grown_shard = assign(key, grown) if grown else F.lit(None).cast("int")
    placed = materialize(full.select("*", assign(key, leaves).alias("shard"), block.alias("block"), grown_shard.alias("grown_shard")), "shards")
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("__id", "crc", "n")
    rows = placed.withColumn("at", F.row_number().over(inside).cast("long"))
    starts = F.broadcast(starts) if len(leaves) * blocks <= BROADCAST_STARTS else starts
    return rows.join(starts, ["shard", "block"]).select(
        F.col("__id").alias(id_col),
        (F.col("n") + ROW_BYTES).alias("size"),
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("start") + F.col("at") - 1).alias("slot"),
        "grown_shard",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 23, and where they would be with one shard more."""
    out = shard_documents(table(spark, sf_dir, "documents"), topology(SHARDS), topology(SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_draw(node: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5(k || '|{node}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {2.0**52!r}) / {float(weight)!r}"


def _sql_assign(leaves: list[Leaf], level: int = 0, path: str = "") -> str:
    if level == 3:
        return str(leaves[0].shard)
    names: dict[str, list[Leaf]] = {}
    for x in leaves:
        names.setdefault((x.region, x.rack, str(x.shard))[level], []).append(x)
    below = [_sql_assign(xs, level + 1, f"{path}/{n}") for n, xs in names.items()]
    if len(names) == 1:
        return below[0]
    draws = ", ".join(_sql_draw(f"{path}/{n}", sum(x.weight for x in xs)) for n, xs in names.items())
    return f"CASE list_position([{draws}], least({draws})) " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(below, 1)) + " END"


OP2_SQL = f"""
WITH RECURSIVE step(i, k, v) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents
), r AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT AS n,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc,
    {_sql_assign(topology(SHARDS))} AS shard, {_sql_assign(topology(SHARDS + 1))} AS grown_shard,
    k
  FROM d, crc_table
)
SELECT doc_id, n + {ROW_BYTES} AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k || '|' || crc || '|block'), 1, 8))::BIGINT % {BLOCKS}, doc_id NULLS FIRST, crc, n) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM r
"""
