"""Substring dedup: super-k-mer partitioning of word windows.

A window is ``WINDOW`` consecutive words of one text.  Its minimiser is the
smallest hash among the runs of ``MINIMISER`` words in it; consecutive windows
with the same minimiser form a super-k-mer and travel as one packed string of
words to the minimiser's bucket, where equal windows must meet.  There the
windows are sorted by a hash, runs of equal hashes are compared word for word,
and all but the first occurrence (by document, then by place) are repeats.  The
words that a repeat covers are removed.

Before they travel, equal super-k-mers of one batch are collapsed: only the
earliest can hold a first occurrence, the others are repeats as a whole.  So a
passage that many documents share reaches its bucket once per batch, not once
per document; what is known to repeat already needs no comparison and travels
by any bucket, dealt by its document.

Buckets follow the input: one for each ``BUCKET_BYTES`` of packed strings, and
``BUCKETS`` times the shuffle partitions at least.  Minimisers that would fill a
bucket on their own are found beforehand, on one document in ``SAMPLE`` (this
decides only where windows meet, never what is found); their windows are cut up
once more, by a minimiser of ``LONG`` words, into other buckets.  A bucket that
still exceeds ``BUCKET_BYTES`` is compared in passes, each over the windows of
one class of hashes.

Defined results: a null text has no words; a text of fewer words than a window
loses none; a null id comes before all others; rows with the same id are one
document's for the order, so a row repeated as it is keeps its words; such rows
are told apart by the 64-bit hash of their text, so each loses its own words
only; an empty table gives an empty table; columns other than id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, mark, materialize
from .common import NULL_ID, table, text_or_empty

WINDOW = 20
MINIMISER = 3
#: Words of the minimiser that splits the windows of a frequent one.
LONG = 10
BUCKETS = 4
#: Bytes of unpacked strings that a bucket should have; what has more is compared in passes.
BUCKET_BYTES = 64 << 20
#: Packed strings have about so many times the bytes of the texts.
GROWTH = 3
#: One document in so many tells which minimisers are frequent; so many of them are split at most.
SAMPLE = 16
MOST_FREQUENT = 1 << 16
#: Bytes of texts whose super-k-mers one pass packs, and of packed strings that it hashes.
BATCH_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
MEMO_WORDS = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


class Packer:
    """Cuts texts into super-k-mers and packs them by bucket."""

    def __init__(self, buckets: int, window: int = WINDOW, minimiser: int = MINIMISER, frequent: np.ndarray | None = None):
        self.buckets, self.window, self.minimiser = buckets, window, minimiser
        self.frequent = np.empty(0, np.uint64) if frequent is None else np.sort(frequent)
        self._codes: dict[bytes, int] = {}

    def _code(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self._codes
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def _minima(self, codes: np.ndarray) -> np.ndarray:
        """The minimiser of the window that starts at each word (those past the end are not valid).

        Where it is a frequent one, the minimiser of ``LONG`` words stands for it.
        """
        n, m, k = len(codes), self.minimiser, self.window
        h = np.zeros(n - m + 1, np.uint64)
        for j in range(m):
            h += _mix(codes[j : n - m + 1 + j] * _ODD[j % 3] + np.uint64(j))
        h = _mix(h)
        low = _sliding_min(h, k - m + 1)
        if len(self.frequent) and k > LONG:
            hot = self.frequent[np.minimum(np.searchsorted(self.frequent, low), len(self.frequent) - 1)] == low
            if hot.any():
                wide = np.zeros(n - LONG + 1, np.uint64)
                for j in [*range(0, LONG - m, m), LONG - m]:  # these runs cover all ``LONG`` words
                    wide = _mix(wide * _ODD[0] + h[j : j + len(wide)])
                low = np.where(hot, _sliding_min(wide, k - LONG + 1), low)
        return low

    def _windows(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
        """All words, words and number of each text with a window, each word's place in its text, minimisers, and which start a window."""
        words: list[bytes] = []
        sizes, owners = [], []
        for i, raw in enumerate(texts):
            own = raw.split()
            if len(own) >= self.window:
                words += own
                sizes.append(len(own))
                owners.append(i)
        sizes_a = np.array(sizes, np.int64)
        start = np.arange(len(words)) - np.repeat(np.cumsum(sizes_a) - sizes_a, sizes_a)
        low = self._minima(self._code(words)) if words else np.empty(0, np.uint64)
        valid = (start <= np.repeat(sizes_a - self.window, sizes_a))[: len(low)]
        return words, sizes_a, owners, start, low, valid

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Minimisers of the texts and how many windows have each."""
        *_, low, valid = self._windows(texts)
        return np.unique(low[valid], return_counts=True)

    def pack(self, ids: list[int], keys: list[int], texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """``(bucket, payload)`` for the texts: super-k-mers to compare, and stretches that repeat already."""
        rows: dict[tuple[int, int], int] = {}
        for i, name in enumerate(zip(ids, keys, strict=True)):
            rows.setdefault(name, i)
        if len(rows) < len(texts):  # a row repeated as it is has the same spans
            once = sorted(rows.values())
            ids, keys, texts = ([x[i] for i in once] for x in (ids, keys, texts))
        words, sizes_a, owners, start, low, valid = self._windows(texts)
        if not words:
            return
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        first = np.flatnonzero(new)
        past = np.minimum.reduceat(np.where(valid, len(low), np.arange(len(low))), first)  # the next start without a window
        past = np.minimum(past, np.append(first[1:], len(low)))
        owner = np.repeat(owners, sizes_a)[first]
        doc, key = np.asarray(ids, np.int64)[owner], np.asarray(keys, np.int64)[owner]
        at, n = start[first], past - first
        bucket = (_mix(low[first]) % np.uint64(self.buckets)).astype(np.int64)
        begin, end = np.where(first > 0, ends[first - 1] + 1, 0).tolist(), ends[past - 1 + self.window - 1].tolist()
        order = np.lexsort((at, doc, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        known: list[np.ndarray] = []
        for group in np.split(order, cuts):
            seen: dict[bytes, int] = {}
            live, gone = [], []
            for i in group.tolist():
                lead = seen.setdefault(line[begin[i] : end[i]], i)
                if lead == i or (doc[lead] == doc[i] and at[lead] == at[i]):
                    live.append(i)
                else:
                    gone.append(i)
            live, gone = (np.array(x, np.int64) for x in (live, gone))
            live = live[np.lexsort((at[live], key[live], doc[live]))]
            known.append(gone)
            strings = b"\n".join([line[begin[i] : end[i]] for i in live.tolist()])
            if len(live):
                yield int(bucket[group[0]]), _payload([doc[live], key[live], at[live]], [doc[:0], key[:0], at[:0], at[:0]], strings)
        gone = np.concatenate(known)
        if len(gone):
            gone = gone[np.lexsort((at[gone], key[gone], doc[gone]))]
            anywhere = int(_mix(np.array([doc[gone[0]]]).astype(np.uint64) + np.uint64(len(gone)))[0] % np.uint64(self.buckets))
            yield anywhere, _payload([doc[:0], key[:0], at[:0]], [doc[gone], key[gone], at[gone], at[gone] + n[gone] + self.window - 1], b"")


def _sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    rest = span - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


#: Bytes of each number in a payload: of a document its id (as steps, which are small), key, and rows in both parts; then the places.
_DOCUMENT, _LIVE, _GONE = (np.int64, np.int64, np.int32, np.int32), (np.int32,), (np.int32, np.int32)


def _payload(live: list[np.ndarray], gone: list[np.ndarray], strings: bytes) -> bytes:
    """Compressed numbers and strings; both parts are in order of id and key, which are kept once for each document."""
    docs, keys = (np.concatenate([live[i], gone[i]]) for i in (0, 1))
    order = np.lexsort((keys, docs))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(docs[order]) != 0) | (np.diff(keys[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    firsts = order[new]
    rows = [np.bincount(x, minlength=len(firsts)) for x in (number[: len(live[0])], number[len(live[0]) :])]
    columns = []
    for part, kinds in (([np.diff(docs[firsts], prepend=0), keys[firsts], *rows], _DOCUMENT), (live[2:], _LIVE), (gone[2:], _GONE)):
        columns += [np.ascontiguousarray(x).astype(k).tobytes() for x, k in zip(part, kinds, strict=True)]
    raw = b"".join([struct.pack("<qqq", len(firsts), len(live[0]), len(gone[0])), *columns, strings])
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = pa.decompress(payload[8:], struct.unpack("<q", payload[:8])[0], codec="zstd", asbytes=True)
    at, parts = 24, []
    for n, kinds in zip(struct.unpack("<qqq", raw[:24]), (_DOCUMENT, _LIVE, _GONE), strict=True):
        rows = np.empty((len(kinds), n), np.int64)
        for i, kind in enumerate(kinds):
            rows[i] = np.frombuffer(raw, kind, n, at)
            at += n * np.dtype(kind).itemsize
        parts.append(rows)
    (steps, keys, *counts), *places = parts
    names = np.stack([np.cumsum(steps), keys])
    live, gone = (np.concatenate([np.repeat(names, n, 1), x]) for n, x in zip(counts, places, strict=True))
    return live, gone, raw[at:]


class _Hasher:
    """Hashes of the windows of packed strings; equal windows have equal hashes."""

    def __init__(self, window: int):
        self.window = window
        self._grow(PIECE_BYTES)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self._up = np.cumprod(np.full(size, np.uint64(pow(_BASE, -1, 2**64))))
            self._down = np.cumprod(np.full(size, np.uint64(_BASE)))

    def hashes(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lines of words: each window's hash, line, first byte and end."""
        if len(piece) > len(self._up):
            self._grow(len(piece))
        raw = np.frombuffer(piece, np.uint8)
        breaks = np.flatnonzero((raw == 32) | (raw == 10))
        begin, end = np.concatenate([[0], breaks + 1]), np.append(breaks, len(raw))
        lines = np.concatenate([[0], np.cumsum(raw[breaks] == 10)])
        last = self.window - 1
        first = np.flatnonzero(lines[: len(lines) - last] == lines[last:]) if len(lines) > last else np.empty(0, np.int64)
        s, e = begin[first], end[first + last]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw.astype(np.uint64) * self._up[: len(raw)], out=sums[1:])
        return _mix((sums[e] - sums[s]) * self._down[s]), lines[first], s, e


def repeats(payloads: list[bytes], window: int = WINDOW, most_bytes: int = BUCKET_BYTES) -> list[np.ndarray]:
    """``[doc, key, first, past]`` of the stretches of words that repeats in one bucket cover."""
    parts = [_unpack(p) for p in payloads]
    gone = [g for _, g, _ in parts]
    live = np.concatenate([x for x, *_ in parts], 1)
    strings = [s for *_, text in parts if text for s in text.split(b"\n")]
    del parts
    order = np.lexsort((live[2], live[1], live[0]))
    again = np.zeros(len(order), bool)
    again[1:] = (np.diff(live[:, order], axis=1) == 0).all(0)  # rows repeated as they are
    order = order[~again]
    order = order[np.lexsort((live[2, order], live[0, order]))]
    seen: dict[bytes, int] = {}
    kept, whole = [], []
    for i in order.tolist():
        lead = seen.setdefault(strings[i], i)
        (kept if lead == i or (live[0, lead] == live[0, i] and live[2, lead] == live[2, i]) else whole).append(i)
    del seen
    if whole:
        n = np.array([strings[i].count(b" ") + 1 for i in whole])
        gone.append(np.concatenate([live[:, whole], (live[2, whole] + n)[None]]))
    strings = [strings[i] for i in kept]
    live = live[:, kept]

    hasher = _Hasher(window)
    passes = -(-sum(map(len, strings)) // most_bytes) or 1
    for number in range(passes):
        gone += _compared(strings, live, hasher, passes, number)
    return gone


def _compared(strings: list[bytes], live: np.ndarray, hasher: _Hasher, passes: int, number: int) -> list[np.ndarray]:
    """Stretches that repeats cover among the windows whose hash falls to one pass."""
    piece, size, done = [], 0, 0
    found: list[list[np.ndarray]] = []
    for i, s in enumerate(strings):
        piece.append(s)
        size += len(s) + 1
        if size >= PIECE_BYTES or i == len(strings) - 1:
            h, line, b, e = hasher.hashes(b"\n".join(piece))
            place = np.arange(len(h)) - np.searchsorted(line, line)  # the window's number in its super-k-mer
            begins = np.cumsum([0] + [len(x) + 1 for x in piece])
            mine = slice(None) if passes == 1 else h % np.uint64(passes) == number
            found.append([x[mine] for x in (h, line + done, place, b - begins[line], e - begins[line])])
            piece, size, done = [], 0, i + 1
    if not found:
        return []
    h, line, place, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(h):
        return []
    by_hash = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[by_hash][1:] == h[by_hash][:-1]])
    again = np.zeros(len(h), bool)
    starts = np.flatnonzero(~same)
    lead = by_hash[starts[np.cumsum(~same) - 1]]
    firsts: dict[int, dict[bytes, int]] = {}
    for w, first in zip(by_hash[same].tolist(), lead[same].tolist(), strict=True):
        text = strings[line[w]][b[w] : e[w]]
        if text != strings[line[first]][b[first] : e[first]]:  # equal hashes of different words
            first = firsts.setdefault(first, {}).setdefault(text, w)
        again[w] = live[0, line[first]] != live[0, line[w]] or live[2, line[first]] + place[first] != live[2, line[w]] + place[w]
    hit = np.flatnonzero(again)
    if not len(hit):
        return []
    cut = np.concatenate([[True], (line[hit][1:] != line[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)])
    runs = np.flatnonzero(cut)
    n = np.diff(np.append(runs, len(hit)))
    at = live[2, line[hit[runs]]] + place[hit[runs]]
    return [np.stack([live[0, line[hit[runs]]], live[1, line[hit[runs]]], at, at + n + hasher.window - 1])]


_SPANS = "id long, key long, first int, past int"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows ``(id, key, text)`` in groups of ``BATCH_BYTES`` of texts."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for i, k, t in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))), strict=True):
            ids.append(i)
            keys.append(k)
            texts.append(t)
            size += len(t)
            if size >= BATCH_BYTES:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
    if texts:
        yield ids, keys, texts


def plan_buckets(docs: DataFrame, window: int = WINDOW, *, sample: int | None = None, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, np.ndarray]:
    """Number of buckets for rows ``(id, key, text)``, and the minimisers too frequent for one bucket.

    Estimated on one row in ``sample``: where windows meet depends on it, what
    is found does not.  A minimiser is frequent if it has as many windows as a
    bucket should have, so there can't be more of them than buckets.
    """

    sample, began = sample or SAMPLE, mark()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(1, window)
        for _, _, texts in _texts(batches):
            low, n = packer.count(texts)
            lows = pa.array(np.append(low.view(np.int64), 0), mask=np.append(np.zeros(len(low), bool), True))
            yield pa.RecordBatch.from_arrays([lows, pa.array(np.append(n, n.sum())), pa.array(np.append(np.zeros(len(n), np.int64), sum(map(len, texts))))], names=["low", "n", "bytes"])

    counted = docs.where(F.pmod(F.xxhash64("id", "key"), F.lit(sample)) == 0).select("id", "key", "text").mapInArrow(count, "low long, n long, bytes long")
    counted = materialize(counted.groupBy("low").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "repeats-minimisers")
    sums = counted.where(F.col("low").isNull()).first()  # the row without a minimiser has the sums
    total, size = (sums["n"], sums["bytes"]) if sums else (0, 0)
    buckets = max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * sample * GROWTH // bucket_bytes))
    many = counted.where(F.col("low").isNotNull() & (F.col("n") * buckets >= total)).orderBy(F.desc("n"), "low").limit(MOST_FREQUENT).collect()
    discard(began)
    return buckets, np.array([r["low"] for r in many], np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(id, key, first, past)``: stretches of words to remove, of rows ``(id, key, text)``."""
    buckets, frequent = plan_buckets(docs, window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, window, frequent=frequent)
        for ids, keys, texts in _texts(batches):
            rows = list(packer.pack(ids, keys, texts))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "payload"])

    def compare(rows: pa.Table) -> pa.Table:
        found = np.concatenate([np.empty((4, 0), np.int64), *repeats(rows.column("payload").to_pylist(), window)], 1)
        return pa.table([pa.array(found[0]), pa.array(found[1]), pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(np.int32))], names=["id", "key", "first", "past"])

    packed = docs.select("id", "key", "text").mapInArrow(pack, "bucket long, payload binary")
    return packed.groupBy("bucket").applyInArrow(compare, _SPANS)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, text, spans)``: every row with the stretches of words (first, past) that repeats cover."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = repeated_spans(rows, window).groupBy("id", "key").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    joined = rows.join(spans, ["id", "key"], "left")
    return joined.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), F.col("text").alias(text_col), F.coalesce("spans", F.array()).alias("spans"))


def kept_words(text: str, spans: list[dict]) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the stretches."""
    own = text.encode("utf-8", "surrogatepass").split()
    if not spans:
        return len(own), own
    keep = np.ones(len(own), bool)
    for s in spans:
        keep[s["first"] : s["past"]] = False
    return len(own), [own[i] for i in np.flatnonzero(keep)]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text of ``documents`` without repeated windows."""
    marked = remove_repeats(table(spark, sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, left = kept_words(text, spans)
                n.append(total)
                gone.append(total - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM p),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM r WHERE n > 1) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
