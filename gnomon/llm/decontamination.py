"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words.

Texts and items are normalised alike: A-Z become a-z, and what is neither a
digit, a letter a-z nor beyond ASCII only separates words.  Every ten
consecutive words of an item are a window (an item of fewer words, but not none,
is one window).  A word inside an occurrence of a window is hit; the hit
stretches are mapped back to offsets in the original text.

The automaton reads words, not characters, each as one to three symbols (the more
frequent in the benchmark, the fewer).  Of each item it has every seventh run of ``RUN`` words: any window has one of them, so that one
scan of a text meets all occurrences, with a seventh of the windows' states.
Where a run ends, the windows around it are looked up in a table of all windows
(by hash, then word for word).  It takes about five bytes of memory for each byte
of the benchmark.

Every worker builds the automaton once and keeps it for all its tasks.  What is
sent has a checked size: a benchmark of more than ``PART_BYTES`` is cut by item
into parts, one on the driver at a time, and there is one automaton and one scan
for each; the stretches of all parts are merged.

Defined results: a null text has no words; a null item or one without words has
no window; a null item id has no name to report but its words are hit; an item id
that is repeated counts once; with an empty benchmark nothing is hit; repeated
rows give repeated rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_texts, table

WINDOW = 10
#: Words of the runs that the automaton has.
RUN = 3
#: Bytes of benchmark texts in one automaton; a part never exceeds this by more than one item.
PART_BYTES = 64 << 20
#: Words of texts whose places are looked up at once.
LOOKUP = 1 << 16

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_KEEP = frozenset(range(48, 58)) | frozenset(range(97, 123)) | frozenset(range(128, 256))
_FOLD = bytes(b if b in _KEEP else 32 for b in bytes(range(256)).translate(bytes.maketrans(_UPPER, _LOWER)))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str) -> list[bytes]:
    """The normalised words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: Words of one symbol; leads of words of two; trails of each symbol.
ONE, TWO, TRAILS = 64, 64, 128
#: Where the trails of words of two and of three symbols begin, and the symbol of all words that the items don't have.
SECOND, THIRD, UNKNOWN = 1 << 20, 1 << 21, 1 << 22


def symbols(words_: int) -> np.ndarray:
    """The symbols of words 0 to ``words_``, a row each, -1 where a word has fewer; 0 is unknown.  No symbol leads a word and trails another."""
    k = np.arange(words_ + 1) - 1
    two = k - ONE
    three = two - TWO * TRAILS
    out = np.full((len(k), 3), -1, np.int32)
    out[:, 0] = np.select([k < 0, two < 0, three < 0], [np.full(len(k), UNKNOWN), k, ONE + two // TRAILS], ONE + TWO + three // TRAILS**2)
    out[:, 1] = np.select([two < 0, three < 0], [-np.ones(len(k), np.int64), SECOND + two % TRAILS], SECOND + TRAILS + three // TRAILS % TRAILS)
    out[:, 2] = np.where(three < 0, -1, THIRD + three % TRAILS)
    return out


_SPREAD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(ids: np.ndarray) -> np.ndarray:
    """32 bits of each row of word numbers."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = (h ^ ids[:, j].astype(np.uint64)) * _SPREAD
        h = (h ^ (h >> np.uint64(29))) * _STEP
    return (h >> np.uint64(32)).astype(np.uint32)


class Scanner:
    """The automaton over some items' words, and the table of their windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        import ahocorasick

        self._size = size
        self._numbers: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        numbers, lengths, owners = [], [], []
        for item, text in items:
            own = words(text or "")
            if own:
                for w in set(own).difference(self._numbers):
                    self._numbers[w] = len(self._numbers) + 1
                numbers.append(self._numbered(own))
                lengths.append(len(own))
                owners.append(names.setdefault(item, len(names)))
        self._names = list(names)
        self._owners = np.array(owners, np.int32)
        self._words = np.concatenate([np.empty(0, np.int32), *numbers])
        del numbers
        # the most frequent word is 1, and so on
        rank = np.empty(len(self._numbers) + 1, np.int32)
        rank[np.argsort(-np.bincount(self._words, minlength=len(rank))[1:], kind="stable") + 1] = np.arange(1, len(rank))
        rank[0] = 0
        self._words = rank[self._words]
        self._numbers = {w: int(rank[i]) for w, i in self._numbers.items()}
        lengths = np.array(lengths, np.int64)
        self._starts = np.cumsum(lengths) - lengths

        # the windows by length (shorter ones are whole items): their hashes in order, and their places
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({size, *lengths[lengths < size].tolist()} if len(lengths) else ()):
            if n < size:
                at = self._starts[lengths == n]
            else:
                last = np.repeat(self._starts + lengths - size, lengths)
                at = np.flatnonzero(np.arange(len(self._words)) <= last)
                del last
            if not len(at):
                continue
            h = np.concatenate([_hashes(self._rows(self._words, part, n)) for part in np.array_split(at, len(at) // LOOKUP + 1)])
            order = np.argsort(h, kind="stable")
            self._tables[n] = h[order], at[order].astype(np.int32)

        self._symbols = symbols(len(self._numbers))
        run = min(RUN, size)
        self._step = size - run + 1
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for first, n in zip(self._starts.tolist(), lengths.tolist(), strict=True):
            codes, ends = self._coded(self._words[first : first + n])
            codes, ends = codes.tolist(), [0, *(ends + 1).tolist()]
            for at in range(0, max(n - run, 0) + 1, self._step):
                past = min(at + run, n)
                self._automaton.add_word(tuple(codes[ends[at] : ends[past]]), past - at)
        if len(self._automaton):
            self._automaton.make_automaton()

    def _numbered(self, own: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._numbers.get, own, repeat(0)), np.int32, len(own))

    def _coded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words, and the place of each word's last symbol."""
        rows = self._symbols[numbers]
        there = rows >= 0
        return rows[there], np.cumsum(there.sum(1)) - 1

    @staticmethod
    def _rows(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return numbers[at[:, None] + np.arange(n)]

    def _windows_at(self, numbers: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of places in a text those where a window of ``n`` words is, and the places of equal windows in the items."""
        hashes, places = self._tables[n]
        rows = self._rows(numbers, at, n)
        h = _hashes(rows)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        hit, found = [], []
        for i in np.flatnonzero(high > low).tolist():
            there = places[low[i] : high[i]]
            there = there[(self._rows(self._words, there, n) == rows[i]).all(1)]
            if len(there):
                hit.append(at[i])
                found.append(there)
        return np.array(hit, np.int64), np.concatenate([np.empty(0, np.int32), *found])

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit stretches of words (first, past the last), and items found, sorted."""
        own = words(text)
        if not own or not len(self._automaton):
            return len(own), [], []
        numbers = self._numbered(own)
        codes, ends = self._coded(numbers)
        seen = list(self._automaton.iter(tuple(codes.tolist())))
        if not seen:
            return len(own), [], []
        seen = np.array(seen, np.int64)
        starts = np.searchsorted(ends, seen[:, 0]) + 1 - seen[:, 1]
        spans, places = [], []
        for n in self._tables:
            back = self._step if n == self._size else 1  # a shorter item begins with its run
            at = np.unique((starts[:, None] - np.arange(back)).ravel())
            at = at[(at >= 0) & (at <= len(own) - n)]
            for part in np.array_split(at, len(at) // LOOKUP + 1):
                hit, found = self._windows_at(numbers, part, n)
                spans += [(i, i + n) for i in hit.tolist()]
                places.append(found)
        items = np.unique(self._owners[np.searchsorted(self._starts, np.unique(np.concatenate(places)), "right") - 1])
        return len(own), merge(spans), sorted(x for x in (self._names[i] for i in items.tolist()) if x is not None)


_built: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[str | None, str | None]], size: int) -> Scanner:
    """The automaton of a worker, built by its first task."""
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(items, size)
    return _built[key]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one, in order."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


def original(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Where stretches of words begin and end in the text itself, in code points."""
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    return [{"begin": at[first][0], "end": at[end - 1][1]} for first, end in spans]


def _parts(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark in parts of a checked size; one part is on the driver at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    place = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for i in range(n):
        yield [(r["id"], r["text"]) for r in (items if n == 1 else items.where(place == i)).toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (ids, sorted) and ``spans`` (begin and end in the text)."""
    span = "array<struct<first:int,past:int>>"
    out = docs
    names: list[tuple[str, str]] = []
    for items in _parts(benchmark, item_id_col, item_col, part_bytes):
        sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        del items

        def make(sent=sent, key=key) -> Callable[[list[str]], list[pa.Array]]:
            scanner = _scanner(key, sent.value, window)

            def work(texts: list[str]) -> list[pa.Array]:
                done = [scanner.scan(t) for t in texts]
                spans = [[{"first": a, "past": b} for a, b in s] for _, s, _ in done]
                kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))
                where = [original(t, s) for t, (_, s, _) in zip(texts, done, strict=True)]
                places = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
                return [pa.array([n for n, _, _ in done], pa.int64()), pa.array(spans, kind), pa.array([i for *_, i in done], pa.list_(pa.string())), pa.array(where, places)]

            return work

        got = [fresh(f"__{x}{len(names)}", out.columns) for x in ("n", "spans", "items", "where")]
        out = map_texts(out, text_col, make, f"{got[0]} long, {got[1]} {span}, {got[2]} array<string>, {got[3]} array<struct<begin:int,end:int>>")
        names.append(tuple(got))
    kept = [c for c in docs.columns if c.lower() not in {"n_words", "n_hit", "items", "spans"}]

    def merged(cols: list[str], a: str, b: str):
        """Stretches of all parts as a list without overlaps, in order."""
        rows = F.array_sort(F.concat(*cols))
        empty = F.slice(rows, 1, 0)
        last = lambda acc: F.element_at(acc, -1)
        joined = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)[a].alias(a), F.greatest(last(acc)[b], x[b]).alias(b))))
        return F.aggregate(rows, empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))[b] >= x[a]), joined(acc, x)).otherwise(F.concat(acc, F.array(x))))

    if len(names) == 1:
        n, spans, items, where = (F.col(x) for x in names[0])
    else:
        n = F.col(names[0][0])
        spans = merged([x[1] for x in names], "first", "past")
        items = F.array_sort(F.array_distinct(F.concat(*(x[2] for x in names))))
        where = merged([x[3] for x in names], "begin", "end")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["past"] - x["first"])
    return out.select(*(F.col(f"`{c}`") for c in kept), n.alias("n_words"), hit.alias("n_hit"), items.alias("items"), where.alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole ``documents`` have of the items of ``benchmark``."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, places.n, i, item FROM places JOIN items ON places.k = items.k AND places.n = items.n),
hit_words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
