"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

Every paragraph (a line of the text, as it is) is hashed to a wide vector and the
vectors are summed lane by lane modulo powers of two.  The sum does not depend on
the order of the paragraphs; adding or subtracting one paragraph's vector inserts
or deletes it without a look at the rest.

The lanes: one that counts paragraphs (modulo 2**32); eight dense ones that every
paragraph changes (modulo 2**32), which decide equality; and banks of 64 lanes (modulo
2**16) of which a paragraph changes one each, in the second bank only one
paragraph in sixteen, and so on by sixteenths: two banks at least, and as many
as the longest text needs (``banks_for``).  Only the lanes up to the second bank
are written out; the others serve likeness.  The difference of two fingerprints is the
fingerprint of the paragraphs that they do not share, so the number of lanes that
differ tells how many those are, and with the two counts how alike the documents
are (Jaccard, 0 to 1).

Defined results: a null text is the empty text, which has one empty paragraph;
equal texts have equal fingerprints, as have texts with the same paragraphs in
another order; a null id comes after all others; documents with the same id are
ordered by a hash of their text, then by the text; the only document is its own next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, hex_number, table, text_or_empty

DENSE = 8
LANES = 64
#: One paragraph in so many is in the second bank.
SPARSE = 16
WORD, HALF = 2**32, 2**16
#: Differing lanes up to which a bank tells the number of differing paragraphs.
FULL = 56
#: Banks that every fingerprint has, and those that tell the longest string's paragraphs apart.
BANKS, MOST_BANKS = 2, 7
#: Paragraphs that a bank should get at most, well below what fills it.
LOAD = 80

#: Rows that one block should have, and the most blocks there may be.
BLOCK_ROWS = 500
MOST_BLOCKS = 1 << 16
COARSE = 256


def banks_for(paragraphs: int) -> int:
    """Banks that tell apart texts which do not share so many paragraphs."""
    banks = BANKS
    while banks < MOST_BANKS and paragraphs > LOAD * SPARSE ** (banks - 1):
        banks += 1
    return banks


def fingerprint(text: Column, banks: int = MOST_BANKS) -> Column:
    """The lanes of a text's fingerprint: ``array<bigint>`` of 1 + 8 and 64 for each bank."""
    hashed = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    return F.transform(F.array(hashed), lambda x: _lanes(x, banks))[0]


def _lanes(hashes: Column, banks: int) -> Column:
    """Sums over the digests of all paragraphs."""

    def total(values: Column, modulus: int) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x) % modulus)

    def digits(x: Column, first: int, n: int) -> Column:
        return hex_number(F.substring(x, first, n))

    def bank(entries: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: total(F.transform(F.filter(entries, lambda e: e["lane"] == j), lambda e: e["v"]), HALF))

    def entries(lane_at: int, value_at: int, of: Column = hashes) -> Column:
        return F.transform(of, lambda x: F.struct((digits(x, lane_at, 2) % LANES).alias("lane"), (digits(x, value_at, 4) * 2 + 1).alias("v"), (digits(x, 63, 2) % SPARSE).alias("s")))

    def ending_in_zeros(k: int) -> Column:
        return F.filter(hashes, lambda x: F.substring(x, 65 - k, k) == F.lit("0" * k))

    def dense_lane(j: int) -> Column:
        return total(F.transform(hashes, lambda x: digits(x, 8 * j + 1, 8)), WORD)

    count = F.array(F.size(hashes).cast("long"))
    dense = F.array(*map(dense_lane, range(DENSE)))
    # bound to a variable, so that they are parsed once and not once for each lane
    all_banks = [entries(1, 3), F.filter(entries(7, 9), lambda e: e["s"] == 0)]
    for k in range(BANKS, banks):
        all_banks.append(entries(6 * k + 1, 6 * k + 3, ending_in_zeros(k)))
    bound = F.struct(*(b.alias(f"b{k}") for k, b in enumerate(all_banks)))
    return F.transform(F.array(bound), lambda x: F.concat(count, dense, *(bank(x[f"b{k}"]) for k in range(banks))))[0]


def _combine(a: Column, b: Column, sign: int) -> Column:
    """Lane by lane, modulo each lane's power."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y * sign), lambda x, i: F.pmod(x, F.when(i <= DENSE, F.lit(WORD)).otherwise(F.lit(HALF))))


def insert(fp: Column, paragraphs: Column, banks: int = MOST_BANKS) -> Column:
    """The fingerprint with the paragraphs of a text added."""
    return _combine(fp, fingerprint(paragraphs, banks), 1)


def delete(fp: Column, paragraphs: Column, banks: int = MOST_BANKS) -> Column:
    """The fingerprint with the paragraphs of a text taken away."""
    return _combine(fp, fingerprint(paragraphs, banks), -1)


def to_string(fp: Column) -> Column:
    """The lanes up to the second bank in hexadecimal digits: 8 for each of the first nine, then 4."""
    return F.array_join(F.transform(F.slice(fp, 1, 1 + DENSE + BANKS * LANES), lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i <= DENSE, F.lit(8)).otherwise(F.lit(4)), F.lit("0")))), "")


def likeness(a: Column, b: Column, banks: int = MOST_BANKS) -> Column:
    """Estimated share of common paragraphs (Jaccard) of two fingerprints; 1 if they are equal."""
    differ = F.zip_with(a, b, lambda x, y: (x != y).cast("int"))

    def in_bank(k: int) -> Column:
        return F.aggregate(F.slice(differ, DENSE + 2 + k * LANES, LANES), F.lit(0), lambda s, x: s + x).cast("double")

    def shown(lanes: Column) -> Column:
        return F.ln(1 - lanes / LANES) * -float(LANES)

    both = (a[0] + b[0]).cast("double")
    apart = both
    for k in reversed(range(banks)):
        lanes = in_bank(k)
        apart = F.when(lanes <= FULL, shown(lanes) * float(SPARSE**k)).otherwise(apart)
    apart = F.greatest(apart, F.abs(a[0] - b[0]).cast("double"))
    return F.when(a == b, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), (both - apart) / (both + apart)), 9))


def _blocks(ids: DataFrame) -> tuple[Column, bool]:
    """A column that numbers blocks of neighbours in rising order of ``__id`` and ``tie``, and whether it needs ``tie``.

    The driver gets at most ``COARSE`` quantiles, the counts of their ids and one
    count; blocks follow the quantiles and, between two of them, equal steps.  An
    id with a share of the rows above ``1 / COARSE`` is a quantile, so that its
    count is known: its rows are split by equal steps of ``tie``.
    """
    rows = ids.count()
    blocks = max(1, min(MOST_BLOCKS, math.ceil(rows / BLOCK_ROWS)))
    coarse = min(COARSE, blocks)
    shares = [i / coarse for i in range(coarse)] + [1.0]
    found = ids.agg(F.percentile_approx("__id", shares, 10000)).first()[0] if rows else None
    edges = sorted(set(found or [0]))
    at = F.greatest(F.size(F.filter(F.lit(edges), lambda e: e <= F.col("__id"))), F.lit(1))
    fine = math.ceil(blocks / len(edges))
    here = F.element_at(F.lit(edges), at)
    block = at.cast("long") * fine
    if fine > 1:
        low, high = [float(x) for x in edges], [float(x) for x in edges[1:]] + [float(edges[-1]) + 1]
        start, above = F.element_at(F.lit(low), at), F.element_at(F.lit(high), at)
        step = F.floor((F.col("__id").cast("double") - start) / F.greatest(above - start, F.lit(1.0)) * fine)
        block = block + F.least(F.greatest(step, F.lit(0)), F.lit(fine - 1))
    counts = dict(ids.where(F.col("__id").isin(edges)).groupBy("__id").count().collect()) if rows else {}
    size = max(BLOCK_ROWS, rows / MOST_BLOCKS)
    parts = [math.ceil(counts.get(x, 0) / size) for x in edges]
    if max(parts) <= 2:
        return block, False
    within = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.element_at(F.lit(parts), at))
    return block * (max(parts) + 1) + F.when(F.col("__id") == here, F.greatest(F.least(within, F.element_at(F.lit(parts), at) - 1), F.lit(0))).otherwise(max(parts)), True


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with ``next_<c>`` of the row after it in falling order of ``__id``; the first after the last.

    Rows of one id follow each other by a hash of the first of ``columns``, then by
    that column itself.  One shuffle of the rows by blocks of neighbours.  The first
    row of each block also goes, as a ghost, to the block before it, whose last row
    needs it.  The broadcast table has one row per block: those of the quantiles and
    those of hot ids, each ``MOST_BLOCKS`` plus ``COARSE`` at most.
    """
    tied = docs.withColumn("tie", F.xxhash64(columns[0]))
    block, split = _blocks(docs.select("__id"))
    place = ["__id", "tie"] if split else ["__id"]
    firsts = tied.groupBy(block.alias("block")).agg(F.max(F.struct(*place)).alias("first")).select("block", "first.*")
    rising = Window.orderBy("block")
    ends = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    targets = firsts.select(*place, F.coalesce(F.lead("block").over(rising), F.first("block").over(ends)).alias("target"))
    rows = tied.withColumn("block", block).join(F.broadcast(targets), place, "left")
    places = F.when(F.col("target").isNull(), F.array(F.struct(F.col("block"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("block"), F.lit(False).alias("ghost")), F.struct(F.col("target").alias("block"), F.lit(True).alias("ghost")))
    )
    dealt = rows.withColumn("place", F.explode(places)).select("__id", "tie", *columns, "place.*")
    order = Window.partitionBy("block").orderBy("ghost", F.col("__id").desc(), F.col("tie").desc(), F.col(columns[0]).desc())
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select("__id", "ghost", *columns, *nexts).where(~F.col("ghost")).drop("ghost")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__id"), text_or_empty().alias("text"))
    longest = docs.agg(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    # an edited text has the paragraphs of two texts at most, and is compared with one more
    banks = banks_for(3 * (longest or 0))
    rows = with_next(docs.withColumn("fp", fingerprint(F.col("text"), banks)), ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_fp", fingerprint(F.col("edited"), banks))
    return rows.select(
        F.when(F.col("__id") != NULL_ID, F.col("__id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        to_string(F.col("fp")).alias("fingerprint"),
        to_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), banks).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp"), banks).alias("near_next"),
    )


def _sql_lanes(text: str) -> str:
    digits = lambda at, n: f"('0x' || substr(x, {at}, {n}))::BIGINT"
    bank = lambda lane, value, more: (
        f"list_transform(range({LANES}), lambda j: coalesce(list_sum(list_transform(list_filter(h, lambda x: {digits(lane, 2)} % {LANES} = j{more}), lambda x: {digits(value, 4)} * 2 + 1)), 0)::BIGINT % {HALF})"
    )
    dense = ", ".join(f"list_sum(list_transform(h, lambda x: {digits(8 * j + 1, 8)}))::BIGINT % {WORD}" for j in range(DENSE))
    return f"(SELECT list_concat([len(h)::BIGINT, {dense}], {bank(1, 3, '')}, {bank(7, 9, f' AND {digits(63, 2)} % {SPARSE} = 0')}) FROM (SELECT list_transform(string_split({text}, chr(10)), lambda p: sha256(p)) AS h))"


def _sql_likeness(a: str, b: str) -> str:
    differ = lambda first: f"len(list_filter(range({first}, {first + LANES}), lambda i: {a}[i] <> {b}[i]))::DOUBLE"
    one, two, both = differ(DENSE + 2), differ(DENSE + 2 + LANES), f"({a}[1] + {b}[1])::DOUBLE"
    shown = lambda x, times: f"ln(greatest(1 - {x} / {LANES}.0::DOUBLE, 1e-9)) * -{LANES}.0::DOUBLE * {times}"
    apart = f"greatest(CASE WHEN {one} <= {FULL} THEN {shown(one, 1)} WHEN {two} <= {FULL} THEN {shown(two, SPARSE)} ELSE {both} END, abs({a}[1] - {b}[1])::DOUBLE)"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, ({both} - {apart}) / ({both} + {apart})), 9) END"


_SQL_STRING = f"array_to_string(list_transform(range(1, {2 + DENSE + 2 * LANES}), lambda i: lower(lpad(to_hex(%s[i]), CASE WHEN i <= {DENSE + 1} THEN 8 ELSE 4 END, '0'))), '')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)
), e AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n
), f AS (
  SELECT *, {_sql_lanes("text")} AS fp, {_sql_lanes("edited")} AS efp, {_sql_lanes("next_text")} AS nfp FROM e
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  {_SQL_STRING % "fp"} AS fingerprint, {_SQL_STRING % "efp"} AS edited_fingerprint,
  {_sql_likeness("fp", "efp")} AS near_edited, {_sql_likeness("fp", "nfp")} AS near_next
FROM f
"""
