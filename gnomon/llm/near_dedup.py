"""MinHash near-dedup: DartMinHash signatures, banded joining, exact classes.

The weighted set of a text has its runs of ``SHINGLE`` words, each with the
number of times it occurs (a text of fewer words, but not none, is one run).
Every element owns a strip of the plane, from 0 to its weight one way and over
all ranks the other.  Hashed darts fall on the strip with density 1, cell by
dyadic cell, the same for every text that has the element; a text keeps those
below its weight and up to a rank that gives it about ``t`` darts.  Each dart
also names a coordinate, and the earliest dart of each coordinate is the
signature there.  Two texts agree at a coordinate with the probability of their
weighted Jaccard similarity.  This takes time for ``t`` darts and the elements, not
for elements times coordinates.

Signatures are cut into ``BANDS`` bands of ``ROWS`` coordinates; texts that agree
on a band are candidates.  Equal texts are one node from the start.  In a bucket of
a band all members are first held against one leader, by their exact similarity;
classes are the connected components.  A bucket that still has members of
different classes is packed into blocks of ``BLOCK_ELEMENTS`` elements, with those of
its lowest class on their own, and worked off in cells of two blocks, but for
pairs of blocks of that class.  Inside a cell two members can only be similar enough if they share
one of the first elements of both, the rarest of the cell first, as many as the
threshold leaves out of a set (prefix filtering), and if their sizes allow it; a
pair counts in the first band that it shares; the exact similarity decides, and
only links that join two classes come out.  So a bucket of many copies never
becomes rows of pairs, a task holds two blocks, dealt by a hash of the id, and no
candidate is left out.  What is known of the hot buckets, those with many members, is
a table of ``MOST_HOT`` rows at most and goes to the members, so that no task has to
read a whole bucket.

Defined results: a null text is the empty text; texts without words are alike
only if they are equal; every different text is one node, named by the smallest id
that has it; a text without an id, and of several texts under one id all but one,
are named by a hash; the class id is the smallest name in the class; repeated rows
give repeated rows; an empty table gives an empty table; columns other than id and
text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, mark, materialize
from .common import table, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Elements of a bucket's members in one block of a cell (4 bytes each).
BLOCK_ELEMENTS = 1 << 18
#: Members from which on a bucket is hot, and the most hot buckets there may be; their table is broadcast.
HOT_MEMBERS, MOST_HOT = 1000, 100_000
#: Members that one member is held against at once.
VERIFIED = 64
#: Beyond ln k, so many darts per coordinate; more make empty coordinates rarer.
SPARE = 3.0
#: Ranks of the first cell; each further cell ends at twice the rank.
FIRST = 0.5
CHUNK_WORDS = 1 << 18
MEMO_WORDS = 500_000

_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _salt(i: int) -> np.uint64:
    """A number of 64 bits for a small one."""
    return _U((i + 1) * 0x165667B19E3779F9 & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in [0, 1)."""
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


class Shingler:
    """Weighted sets of texts."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle = shingle
        self._memo: dict[bytes, int] = {}

    def _codes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of all texts: the text's number, the element's hash, its weight."""
        words: list[bytes] = []
        sizes = []
        for t in texts:
            own = t.encode("utf-8", "surrogatepass").split()
            words += own
            sizes.append(len(own))
        n = np.array(sizes, np.int64)
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        codes = np.concatenate([self._codes(words), np.zeros(self.shingle, np.uint64)])
        owner = np.repeat(np.arange(len(texts)), n)
        start = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(n, n) - start  # words from here to the end of the text
        h = np.zeros(len(words), np.uint64)
        for j in range(self.shingle):
            h = np.where(left > j, _mix(h * _ODD[0] + codes[j : j + len(words)] + _U(j + 1)), h)
        own = (left >= self.shingle) | (start == 0)
        h, owner = h[own], owner[own]
        both = _mix(h + owner.astype(np.uint64) * _ODD[1])
        order = np.argsort(both)
        both = both[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        weight = np.diff(np.append(first, len(both)))
        owner, h = owner[order][first], h[order][first]
        order = np.argsort(owner, kind="stable")
        return owner[order], h[order], weight[order]


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts from uniform numbers."""
    out = np.zeros(len(u), np.int64)
    top = u.max(initial=0.0)
    p = total = math.exp(-mean)
    for i in range(1, 24):
        if total > top:
            break
        out += u >= total
        p *= mean / i
        total += p
    return out


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, coordinates: int) -> np.ndarray:
    """``(texts, coordinates)`` of 64-bit darts, earliest rank first; all ones where a text has no element."""
    nothing = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(texts * coordinates, nothing, np.uint64)
    total = np.bincount(owner, weight, texts)
    reach = coordinates * (math.log(coordinates) + SPARE) / np.maximum(total, 1)
    while len(owner):
        limit = reach[owner]
        low_rank, high_rank, b = 0.0, FIRST, 0
        while low_rank < limit.max():
            in_rank = limit > low_rank
            low_weight, high_weight, a = 0.0, 1.0, 0
            while True:
                at = np.flatnonzero(in_rank & (weight > low_weight))
                if not len(at):
                    break
                area = (high_rank - low_rank) * (high_weight - low_weight)
                split = max(1, round(area))  # cells of area 1 at most, cut along the rank
                size = (high_rank - low_rank) / split
                base = _mix(element[at] + _salt(b << 8 | a))
                for s in range(split):
                    if low_rank + s * size >= limit[at].max():
                        break
                    cell = _mix(base + _salt(s)) if split > 1 else base
                    n = _poisson(_unit(_mix(cell + _ODD[4])), min(area, area / split))
                    idx = np.repeat(np.arange(len(at)), n)
                    nth = np.arange(len(idx)) - np.repeat(np.cumsum(n) - n, n)
                    dart = _mix(cell[idx] + (nth + 1).astype(np.uint64) * _ODD[0])
                    place = _mix(dart + _ODD[1])
                    rank = low_rank + (s + _unit(place)) * size
                    keep = rank <= limit[at][idx]
                    if a:
                        keep &= low_weight + _unit(_mix(place + _ODD[2])) * (high_weight - low_weight) < weight[at][idx]
                    dart, rank, idx = dart[keep], rank[keep], idx[keep]
                    coordinate = ((dart >> _U(32)) * _U(coordinates)) >> _U(32)
                    value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)) | (_mix(dart) & _U(0xFFFFFFFF))
                    np.minimum.at(out, owner[at][idx] * coordinates + coordinate.astype(np.int64), value)
                low_weight, high_weight, a = high_weight, high_weight * 2, a + 1
            low_rank, high_rank, b = high_rank, high_rank * 2, b + 1
        short = (out.reshape(texts, coordinates) == nothing).any(1)[owner]
        owner, element, weight = owner[short], element[short], weight[short]
        reach = reach * 2
    return out.reshape(texts, coordinates)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    rows = signatures.reshape(len(signatures), bands, -1)
    h = np.arange(bands, dtype=np.uint64) * _ODD[1] + _U(1)
    h = np.broadcast_to(h, rows.shape[:2]).copy()
    for j in range(rows.shape[2]):
        h = _mix(h * _ODD[0] + rows[:, :, j])
    return h.astype(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= CHUNK_WORDS or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _bands_of(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc, id, key, bands)`` of rows ``(doc, id, key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        kind = pa.list_(pa.int64())
        for batch in batches:
            texts = batch.column(3).to_pylist()
            out: list = []
            for first, past in _chunks(texts):
                owner, element, weight = shingler.sets(texts[first:past])
                darts = dart_signatures(owner, element, weight, past - first, BANDS * ROWS)
                some = np.bincount(owner, minlength=past - first) > 0
                out += [h if s else [] for h, s in zip(band_hashes(darts), some.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=["doc", "id", "key", "bands"])

    return docs.mapInArrow(run, "doc long, id long, key binary, bands array<long>")


def _elements_of(docs: DataFrame, shingle: int) -> DataFrame:
    """``(id, elements)`` of rows ``(id, text)``: every occurrence of an element as a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends, values = [0], []
            for first, past in _chunks(texts):
                owner, element, weight = shingler.sets(texts[first:past])
                idx = np.repeat(np.arange(len(owner)), weight)
                nth = np.arange(len(idx)) - np.repeat(np.cumsum(weight) - weight, weight)
                values.append((_mix(element[idx] + nth.astype(np.uint64) * _ODD[3]) >> _U(32)).astype(np.uint32).view(np.int32))
                n = np.bincount(owner, weight, past - first).astype(np.int64)
                ends += (ends[-1] + np.cumsum(n)).tolist()
            flat = np.concatenate(values) if values else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "elements"])

    return docs.mapInArrow(run, "id long, elements array<int>")


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose weighted Jaccard similarity is high enough."""
    one = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    two = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    both = pairs.join(one, "b").join(two, "a")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where(common >= F.lit(similarity) * (F.size("ea") + F.size("eb") - common)).select("a", "b").distinct()


def _prefixes(elements: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Of each set, numbers of so many of its elements that two similar sets must share one; the rarest ones."""
    sizes = np.array([len(x) for x in elements])
    _, place, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    out = []
    for own, n in zip(np.split(rank[place], np.cumsum(sizes)[:-1]), sizes.tolist(), strict=True):
        most = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
        out.append(np.partition(own, most - 1)[:most] if most < n else own)
    return out


def cell_links(band: int, ids: np.ndarray, labels: np.ndarray, bands: np.ndarray, elements: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between different classes among ``rows`` x ``cols`` of a cell's members.

    ``bands`` is ``(members, BANDS)``; a pair that shares an earlier band belongs
    to that band's cell.  ``elements`` are sets.  Links that join nothing new are
    left out.
    """
    prefixes = _prefixes(elements, similarity)
    keys = np.concatenate([prefixes[b] for b in cols.tolist()])
    owners = np.repeat(cols, [len(prefixes[b]) for b in cols.tolist()])
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    sizes = np.array([len(x) for x in elements])
    classes = labels.copy()
    out = []
    for a in rows.tolist():
        other = np.zeros(len(ids), bool)
        other[cols] = (classes[cols] != classes[a]) & (np.minimum(sizes[cols], sizes[a]) >= similarity * np.maximum(sizes[cols], sizes[a]))
        if not other.any():
            continue
        low, high = np.searchsorted(keys, prefixes[a], "left"), np.searchsorted(keys, prefixes[a], "right")
        met = np.zeros(len(ids), bool)
        for x, y in zip(low.tolist(), high.tolist(), strict=True):
            met[owners[x:y]] = True
        near = np.flatnonzero(met & other)
        near = near[~(bands[near, :band] == bands[a, :band]).any(1)]
        while len(near):
            some, near = near[:VERIFIED], near[VERIFIED:]
            inside = np.isin(np.concatenate([elements[b] for b in some.tolist()]), elements[a])
            of = sizes[some]
            common = np.add.reduceat(inside, np.cumsum(of) - of, dtype=np.int64)
            for b in some[common >= similarity * (sizes[a] + of - common)].tolist():
                if classes[a] != classes[b]:
                    out.append((int(ids[a]), int(ids[b])))
                    classes[classes == classes[b]] = classes[a]
            near = near[classes[near] != classes[a]]
    return out


def _with_bucket(members: DataFrame, buckets: DataFrame, hot: int) -> DataFrame:
    """Members joined with a table of one row for each bucket, both with ``n``; what hot buckets have goes to their members."""
    few = F.broadcast(buckets.where(F.col("n") > hot).drop("n"))
    rest = members.where(F.col("n") <= hot).join(buckets.where(F.col("n") <= hot).drop("n"), "bucket")
    return members.where(F.col("n") > hot).join(few, "bucket").unionByName(rest)


def _packed(members: DataFrame, facts: DataFrame, hot: int, block_elements: int) -> DataFrame:
    """Blocks of ``(bucket, band, id, n, label, low)``, one row each: every member is in one, with its bands and elements.

    The members of the class ``low`` have blocks of their own, the first ``lows``.
    """

    def pack(block: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        own = block.select(["id", "label", "bands", "elements"]).combine_chunks()
        with pa.ipc.new_stream(sink, own.schema) as writer:
            writer.write_table(own)
        data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return block.select(["bucket", "band", "mine", "lows", "blocks"]).slice(0, 1).append_column("data", data)

    size = facts.select("id", F.size("elements").alias("size"))
    is_low = F.col("label") == F.col("low")
    in_blocks = lambda which: F.ceil(F.sum(F.when(which, F.col("size")).otherwise(0)) / block_elements).cast("int")
    sizes = members.join(size, "id").groupBy("bucket").agg(in_blocks(is_low).alias("lows"), in_blocks(~is_low).alias("rest"), F.max("n").alias("n"))
    of = F.xxhash64("id")
    mine = F.when(is_low, F.pmod(of, F.col("lows"))).otherwise(F.col("lows") + F.pmod(of, F.col("rest"))).cast("int")
    dealt = _with_bucket(members, sizes, hot).select("id", "bucket", "band", "label", mine.alias("mine"), "lows", (F.col("lows") + F.col("rest")).alias("blocks"))
    held = dealt.join(facts, "id").select("bucket", "band", "mine", "lows", "blocks", "id", "label", "bands", "elements")
    return held.groupBy("bucket", "mine").applyInArrow(pack, "bucket long, band int, mine int, lows int, blocks int, data binary")


def _cell_links(members: DataFrame, facts: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Links of ``(bucket, band, id, n, label, low)`` between different classes of a bucket, cell by cell.

    ``facts`` is ``(id, bands, elements)``.  Members are packed into blocks first,
    so what is dealt to the cells is rows of blocks, not of members; two blocks
    of one class have no cell.
    """

    def run(cell: pa.Table) -> pa.Table:
        blocks = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in cell.column("data")]
        both = pa.concat_tables(blocks)
        col = lambda c: both.column(c).to_numpy()
        own = np.stack([x.values.to_numpy() for x in both.column("bands")])
        sets = [np.unique(x.values.to_numpy()) for x in both.column("elements")]
        rows = np.arange(blocks[0].num_rows)
        cols = rows if len(blocks) == 1 else np.arange(len(rows), both.num_rows)
        alone = len(blocks) == 1 and cell.column("i")[0] != cell.column("j")[0]  # the other block is empty
        links = [] if alone else cell_links(cell.column("band")[0].as_py(), col("id"), col("label"), own, sets, rows, cols, similarity)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    packed = _packed(members, facts, hot, BLOCK_ELEMENTS)
    # a block of the class ``low`` meets those of the others; they meet all
    others = F.explode(F.sequence(F.when(F.col("mine") < F.col("lows"), F.col("lows")).otherwise(0), F.col("blocks") - 1))
    dealt = packed.withColumn("other", others).select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "band", "data")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id of the component, for every id that has an edge.

    Each round every node takes the smallest label among itself and its
    neighbours and then its label's label, until nothing changes.  Each round's
    labels are a table in the shared folder.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        after = materialize(closer.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")), "near-labels")
        labels = after.select("id", "label")
        if not after.where("moved").limit(1).count():
            return labels


def node_id(id_col: str, text: Column) -> Column:
    """The id of a row; for null, a hash of its text."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``(id, class_id, representative, row_id, key)`` of every row.

    ``row_id`` and ``key`` tell the different rows apart: the id (for null, a
    hash of the text) and the text's MD5.  The rows that stand for their class
    are those with the text and the smallest id that name it.
    """
    began = mark()
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), node_id(id_col, text).alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    signed = materialize(_bands_of(rows, shingle), "near-bands")
    firsts = materialize(signed.groupBy("key").agg(F.min("id").alias("first")), "near-texts")
    # an id names one text; further ones under it have a hash for a name
    named = firsts.groupBy("first").agg(F.min("key").alias("named"))
    named = firsts.join(named, "first").select("key", "first", F.when(F.col("key") == F.col("named"), F.col("first")).otherwise(F.xxhash64("first", "key")).alias("id"))
    texts = materialize(named, "near-texts")

    # one row for each band of each different text; buckets with company
    bands = materialize(signed.select("key", "bands").where(F.size("bands") > 0).distinct().join(texts, "key").select("id", "bands"), "near-signed")
    banded = materialize(bands.select("id", F.posexplode("bands").alias("band", "bucket")), "near-buckets")
    shared = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1"), "near-shared")
    hot = max(HOT_MEMBERS, banded.count() // MOST_HOT)
    marked = banded.join(F.broadcast(shared.where(F.col("n") > hot)), "bucket", "left")
    cold = marked.where("n IS NULL").select("bucket", "band", "id").join(shared.where(F.col("n") <= hot), "bucket")
    members = materialize(marked.where("n IS NOT NULL").unionByName(cold).select("bucket", "band", "id", "n", "lead"), "near-members")

    wanted = members.select("id").distinct()
    wanted = texts.join(wanted, "id").select("key", F.col("first").alias("id"), F.col("id").alias("node"))
    read = rows.join(wanted, ["key", "id"]).select(F.col("node").alias("id"), "text")
    elements = materialize(_elements_of(read, shingle), "near-elements")

    leads = members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    edges = materialize(_verified(leads, elements, similarity), "near-links")
    labels = components(edges)
    placed = members.where("n > 2").join(labels, "id", "left").select("bucket", "band", "id", "n", F.coalesce("label", "id").alias("label"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("n").alias("n")).where("low != high")
    left = materialize(_with_bucket(placed, mixed.select("bucket", "n", "low"), hot), "near-left")
    if left.limit(1).count():
        facts = left.select("id").distinct().join(bands, "id").join(elements.dropDuplicates(["id"]), "id")
        found = materialize(_cell_links(left, materialize(facts, "near-facts"), similarity, hot), "near-links")
        labels = components(edges.unionByName(found))

    classes = texts.join(labels, "id", "left").select("key", "first", F.coalesce("label", "id").alias("class_id"), (F.coalesce("label", "id") == F.col("id")).alias("stands"))
    classes = materialize(classes, "near-classes")
    discard(began, keep=("near-bands", "near-classes"))
    out = signed.select("doc", "id", "key").join(classes, "key")
    return out.select(F.col("doc").alias(id_col), "class_id", (F.col("stands") & (F.col("id") == F.col("first"))).alias("representative"), F.col("id").alias("row_id"), "key")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document of ``documents``, and whether it stands for it."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "representative")
