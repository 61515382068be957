"""Chat formatting by quotation linking, in DataFrame operations only.

A line's quote level is the number of ``>`` at its head.  The lines of level 0 are
a message's own; what is quoted at level 1 and deeper are passages: each line, and
all lines of one level together (so that a message that was quoted as a whole is
found however it was wrapped), and also each run of neighbouring lines of one
level and each paragraph in it (up to an empty line), joined.  Passages and originals (each own line, run and paragraph, and
all own lines together) are normalised alike (lower case, blanks as one) and hashed; a
passage belongs to the message of the same conversation that says it first.  A
message answers the latest message that it quotes at its lowest linked level;
without a link it answers the one before it.

A conversation comes out in reply order: a message is followed by its first
answer with all that comes of it, then by its second answer with all that comes of
it, and so on, each with its own lines only.  A message that is the first answer to
another one stays in its thread; any further answer opens a thread of its own.  A
thread's path names the answers that lead to it, so that paths and turns sort
messages in reply order.  Paths are found by doubling: after r rounds every path
knows 2**r steps.  Only answers that do not follow what they answer take part
(``heads``), one row each.

A conversation may be of any length: its messages are numbered inside blocks of
``BLOCK`` turns, and a table with one row per thread and block says where each
block starts.  Originals are reduced to the first turn of each passage before they
are joined.

Defined results: a null text is empty; null conversations are one conversation;
messages without a turn come last and are never linked; an empty line is no
passage; messages that share conversation and turn are ordered by role and text and share
their links; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from .common import table, text_or_empty

HEAD = r"^[ \t]*(?:>[ \t]?)*"
BLOCK = 256
NO_TURN = 2**62
#: Names the run that a conversation begins with.
ROOT = -(2**63)


def parse(text: Column) -> Column:
    """The lines of a message as ``array<struct<level, body>>``."""

    def line(x: Column) -> Column:
        head = F.regexp_extract(x, HEAD, 0)
        level = F.length(F.regexp_replace(head, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.substring(x, F.length(head) + 1, F.length(x))).otherwise(x).alias("body"))

    return F.transform(F.split(text, "\n", -1), line)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\x0b\f]+", " "))


def _passages(lines: Column, level: Column) -> Column:
    """Hashes of the lines of a level, its paragraphs and runs, and all of it together; empty ones are none."""
    of_level = F.filter(lines, lambda x: x["level"] == level)
    said = F.filter(F.transform(of_level, lambda x: normalised(x["body"])), lambda x: x != "")
    # neither break is in a normalised line: "\r" stands for a line of another level, an empty line ends a paragraph
    joined = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, normalised(x["body"])).otherwise(F.lit("\r"))), "\n")
    pieces = F.concat(F.split(joined, "\r", -1), F.split(joined, "\r|\n\n+", -1))
    parts = F.filter(F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, "\n+", " "))), lambda x: x != "")
    whole = F.when(F.size(said) > 1, F.array(F.array_join(said, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(said, parts, whole), lambda x: F.md5(x)))


def link(messages: DataFrame) -> DataFrame:
    """``(conv, turn, reply_to, n_quotes, n_linked)`` of every message with quotes, from ``(conv, turn, lines)``."""
    deep = F.filter("lines", lambda x: x["level"] > 0)
    levels = F.array_distinct(F.transform(deep, lambda x: x["level"]))
    quoting = messages.where((F.col("turn") < NO_TURN) & F.exists("lines", lambda x: x["level"] > 0))
    by_level = quoting.select("conv", "turn", F.col("lines"), F.explode(levels).alias("level"))
    quotes = by_level.select("conv", "turn", "level", F.explode(_passages(F.col("lines"), F.col("level"))).alias("passage")).distinct()
    asked = quotes.select("conv", "passage").distinct()
    own = messages.where(F.col("turn") < NO_TURN).select("conv", "turn", F.explode(_passages(F.col("lines"), F.lit(0))).alias("passage"))
    first = own.join(asked, ["conv", "passage"], "left_semi").groupBy("conv", "passage").agg(F.min("turn").alias("origin"))
    found = quotes.join(first, ["conv", "passage"], "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("origin").alias("o"))))
    return found.groupBy("conv", "turn").agg(best["o"].alias("reply_to"), F.count(F.lit(1)).alias("n_quotes"), F.count("origin").alias("n_linked"))


def _running_max(rows: DataFrame, value: Column, name: str, last: int) -> DataFrame:
    """``rows`` of different ``(conv, turn, block)`` with the greatest ``value`` up to ``last`` rows from each, block by block."""
    rows = rows.withColumn("__value", value)
    per = rows.groupBy("conv", "block").agg(F.max("__value").alias("most"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, last)
    carried = per.select("conv", "block", F.max("most").over(before).alias("__earlier"))
    found = rows.withColumn("__near", F.max("__value").over(inside)).join(carried, ["conv", "block"])
    return found.withColumn(name, F.coalesce("__near", "__earlier")).drop("__value", "__near", "__earlier")


def threads(links: DataFrame) -> DataFrame:
    """``(conv, turn, path)`` of all turns, from ``(conv, turn, block, previous, reply_to)``, one row a turn."""
    empty = F.array().cast("array<struct<after:long,head:long>>")
    heads = links.where(F.col("reply_to") != F.col("previous")).select("conv", F.col("turn").alias("head"), F.col("reply_to").alias("after"))
    if not heads.limit(1).count():
        return links.select("conv", "turn", empty.alias("path"))
    jump = F.when(F.col("reply_to") != F.col("previous"), F.col("turn"))
    runs = _running_max(links.where(F.col("turn") < NO_TURN), jump, "run", 0).select("conv", "turn", F.coalesce("run", F.lit(ROOT)).alias("run"))
    runs = materialize(runs, "chat-runs")
    ends = runs.groupBy("conv", "run").agg(F.max("turn").alias("end"))
    eldest = heads.groupBy("conv", "after").agg(F.min("head").alias("eldest"))
    above = heads.join(runs.withColumnRenamed("turn", "after").withColumnRenamed("run", "up"), ["conv", "after"]).join(eldest, ["conv", "after"])
    above = above.join(ends.withColumnRenamed("run", "up"), ["conv", "up"])
    first = (F.col("after") == F.col("end")) & (F.col("head") == F.col("eldest"))
    step = F.when(first, empty).otherwise(F.array(F.struct((-F.col("after")).alias("after"), F.col("head").alias("head"))))
    paths = materialize(above.select("conv", "head", "up", step.alias("path")), "chat-paths")
    while paths.where(F.col("up") != ROOT).limit(1).count():
        over = paths.select("conv", F.col("head").alias("up"), F.col("up").alias("far"), F.col("path").alias("before"))
        longer = paths.join(over, ["conv", "up"], "left")
        paths = materialize(longer.select("conv", "head", F.coalesce("far", F.lit(ROOT)).alias("up"), F.concat(F.coalesce("before", empty), "path").alias("path")), "chat-paths")
    found = runs.join(paths.select("conv", F.col("head").alias("run"), "path"), ["conv", "run"], "left")
    return found.select("conv", "turn", F.coalesce("path", empty).alias("path"))


def conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message: where it stands, what it answers, in which thread, and what it says itself.

    ``thread`` is the turn that opened the message's thread (null for the first
    one), ``depth`` the number of threads that lead to it.
    """
    rows = messages.select(
        F.col(conv_col).alias("id"),
        F.coalesce(F.col(conv_col).cast("string"), F.lit("\0")).alias("conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(NO_TURN)).alias("turn"),
        F.lower(F.coalesce(F.col(role_col), F.lit("user"))).alias("role"),
        parse(text_or_empty(text_col)).alias("lines"),
    )
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    content = F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    turns = _running_max(rows.select("conv", "turn", block).distinct(), F.col("turn"), "previous", -1)
    links = materialize(turns.join(link(rows), ["conv", "turn"], "left"), "chat-links")
    linked = links.join(threads(links), ["conv", "turn"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<after:long,head:long>>")))
    said = rows.select("id", "conv", "turn", "role", content.alias("content")).join(linked, ["conv", "turn"])

    late = (F.col("turn") == NO_TURN).alias("late")
    counts = said.groupBy("conv", late, "path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("late", "path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv", "path", "block").orderBy("turn", "role", "content")
    placed = said.withColumn("at", F.row_number().over(inside)).join(starts, ["conv", "path", "block"])
    return placed.select(
        F.col("id").alias(conv_col),
        F.when(F.col("turn") < NO_TURN, F.col("turn")).alias(turn_col),
        (F.col("start") + F.col("at") - 1).alias("position"),
        F.coalesce("reply_to", F.when(F.col("previous") < NO_TURN, F.col("previous"))).alias("reply_to"),
        F.when(F.col("reply_to").isNotNull(), F.lit("quote")).when(F.col("previous") < NO_TURN, F.lit("previous")).otherwise(F.lit("first")).alias("link"),
        F.try_element_at("path", F.lit(-1))["head"].alias("thread"),
        F.size("path").cast("long").alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "role",
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content")).alias("chat"),
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of ``conversations`` in reply order, without their quotes."""
    return conversations(table(spark, sf_dir, "conversations"))


_SQL_NORM = r"trim(regexp_replace(lower(%s), '[ \t\r\x0b\f]+', ' ', 'g'))"
# neither break is in a normalised line: chr(13) stands for a line of another level, an empty line ends a paragraph
_SQL_PASSAGES = f"""(SELECT list_distinct(list_transform(list_concat(s, CASE WHEN len(s) > 1 THEN [array_to_string(s, ' ')] ELSE [] END,
      list_filter(list_transform(list_concat(string_split(j, chr(13)), string_split_regex(j, '\\r|\\n\\n+')), lambda x: trim(regexp_replace(x, '\\n+', ' ', 'g'))), lambda x: x <> '')), lambda x: md5(x)))
    FROM (SELECT list_filter(list_transform(list_filter(lines, lambda x: %(of)s), lambda x: {_SQL_NORM % "x.body"}), lambda x: x <> '') AS s,
      array_to_string(list_transform(lines, lambda x: CASE WHEN %(of)s THEN {_SQL_NORM % "x.body"} ELSE chr(13) END), chr(10)) AS j))"""

OP10_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, chr(1)) AS conv, turn::BIGINT AS turn, lower(coalesce(role, 'user')) AS role,
    list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {{
      'level': len(regexp_extract(x, '{HEAD}')) - len(replace(regexp_extract(x, '{HEAD}'), '>', '')),
      'body': CASE WHEN contains(regexp_extract(x, '{HEAD}'), '>') THEN substr(x, len(regexp_extract(x, '{HEAD}')) + 1) ELSE x END }}) AS lines
  FROM conversations
), s AS (
  SELECT *, regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.body), chr(10)), '^[ 	
]+|[ 	
]+$', '', 'g') AS content FROM m
), q AS (
  SELECT DISTINCT conv, turn, level, unnest({_SQL_PASSAGES % {"of": "x.level = level"}}) AS passage
  FROM (SELECT conv, turn, lines, unnest(list_distinct(list_transform(list_filter(lines, lambda x: x.level > 0), lambda x: x.level))) AS level FROM m WHERE turn IS NOT NULL)
), o AS (
  SELECT conv, passage, min(turn) AS origin FROM (SELECT conv, turn, unnest({_SQL_PASSAGES % {"of": "x.level = 0"}}) AS passage FROM m WHERE turn IS NOT NULL) GROUP BY ALL
), l AS (
  SELECT q.conv, q.turn, count(*) AS n_quotes, count(origin) AS n_linked,
    arg_max(origin, {{'l': -level, 'o': origin}}) FILTER (WHERE origin IS NOT NULL) AS quoted
  FROM q LEFT JOIN o ON q.conv = o.conv AND q.passage = o.passage AND o.origin < q.turn GROUP BY ALL
), t AS (
  SELECT conv, turn, n_quotes, n_linked, quoted, lag(turn) OVER (PARTITION BY conv ORDER BY turn NULLS LAST) AS previous
  FROM (SELECT DISTINCT conv, turn FROM m) LEFT JOIN l USING (conv, turn)
), k AS (
  SELECT *, coalesce(quoted, previous) AS parent, row_number() OVER (PARTITION BY conv, coalesce(quoted, previous) ORDER BY turn) = 1 AS eldest FROM t WHERE turn IS NOT NULL
), tree AS (
  SELECT conv, turn, []::STRUCT(after BIGINT, head BIGINT)[] AS path FROM k WHERE parent IS NULL
  UNION ALL
  SELECT k.conv, k.turn, CASE WHEN k.eldest THEN tree.path ELSE list_append(tree.path, {{'after': -k.parent, 'head': k.turn}}) END
  FROM tree JOIN k ON k.conv = tree.conv AND k.parent = tree.turn
)
SELECT conv_id, s.turn, row_number() OVER (PARTITION BY s.conv ORDER BY s.turn IS NULL, path, s.turn, role, content) - 1 AS position,
  coalesce(quoted, previous) AS reply_to, CASE WHEN quoted IS NOT NULL THEN 'quote' WHEN previous IS NOT NULL THEN 'previous' ELSE 'first' END AS link,
  path[-1].head AS thread, coalesce(len(path), 0)::BIGINT AS depth,
  coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, role, '<|' || role || '|>' || chr(10) || content AS chat
FROM s JOIN t ON s.conv = t.conv AND s.turn IS NOT DISTINCT FROM t.turn LEFT JOIN tree ON tree.conv = s.conv AND tree.turn = s.turn
"""
