"""Toxicity: class-conditional Kneser-Ney models over characters.

Two language models, one of toxic and one of ordinary labelled texts, give each
character its probability after the four before it.  Orders 5, 4 and 3 belong to
the class (order 5 counts occurrences, the lower ones count the different
characters that go before); an expression too rare for them backs off to order 2,
whose continuation counts both classes share, so that what neither class knows
speaks for neither.  A text's log-likelihood ratio is divided by its length, and
so is the part of it from telling characters (more than ``TELLING`` above even,
each); a logistic curve over the two gives the score.

Learning: the labelled rows fall into four parts by ``crc32(id as text) mod 4``.
Part 2 is held out and never read; the curve is fitted on ``CALIBRATION_ROWS``
rows of part 3 at most, those with the smallest hashes of their ids; all others
are counted, in parts 0, 1 and 3.  All counts come from the whole of the counted
rows and are exact: a table has one row for each distinct gram, so the model
grows with what was counted.  Every worker holds it.

Defined results: a null or empty text is scored as a text of one blank; rows
without a label, or with a null label, are not learned from; several labels of
one id count as their largest; without any labels every score is 0; repeated
rows score alike; columns other than id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, mark, materialize
from .common import map_texts, table, text_or_empty

ORDER = 5
BITS = 12
BLANK = 1
DISCOUNT = 0.75
#: Added to each continuation count of order 2, over so many characters.
FLOOR, ALPHABET = 0.1, 200
HELD_OUT, CALIBRATED = 2, 3
CALIBRATION_ROWS = 20_000
#: Labelled rows up to which the labels are broadcast; beyond, the join is shuffled.
BROADCAST_LABELS = 1_000_000
#: Characters that one numpy pass takes.
CHUNK = 1 << 19
THRESHOLD = 0.3
#: A character speaks for toxicity if its log-likelihood ratio is above this.
TELLING = 1.0


def part(id_col: str = "doc_id") -> Column:
    """0 to 3: ``crc32(id as text) mod 4``; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4).cast("int")


#: Characters below this are codes themselves; the others are two codes, a lead and a trail.
DIRECT, TRAILS = 1984, 1088


def _code_table() -> np.ndarray:
    """Code of each character below ``DIRECT``: letters and all beyond ASCII themselves, else blank."""
    codes = np.arange(DIRECT, dtype=np.int64)
    codes[:128] = np.where((codes[:128] >= 97) & (codes[:128] <= 122), codes[:128], BLANK)
    codes[0] = 0
    return codes


_CODES = _code_table()


def _coded(points: np.ndarray) -> np.ndarray:
    """Code points as codes of 12 bits, none of which stands for two of them."""
    high = points >= DIRECT
    if not high.any():
        return _CODES[points]
    codes = np.where(high, DIRECT + points // TRAILS, _CODES[np.minimum(points, DIRECT - 1)])
    at = np.flatnonzero(high)
    return np.insert(codes, at + 1, DIRECT + 1024 + points[at] % TRAILS)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of order 5 of lower-cased texts, and the text that each belongs to.

    Runs of other characters than letters are one blank; each text begins and
    ends with a blank and has four more before it as a first context.
    """
    joined = "".join("\0 " + t.lower().replace("\0", " ") + " " for t in texts)
    codes = _coded(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BLANK) | (codes[:-1] != BLANK)
    codes = codes[keep]
    starts = codes == 0
    codes = np.repeat(np.where(starts, BLANK, codes), np.where(starts, ORDER - 1, 1))
    owner = np.repeat(np.cumsum(starts) - 1, np.where(starts, ORDER - 1, 1))
    packed = np.zeros(len(codes) - ORDER + 1, np.int64)
    for k in range(ORDER):
        packed = (packed << BITS) | codes[k : len(codes) - ORDER + 1 + k]
    owner = owner[ORDER - 1 :]
    same = np.ones(len(packed), bool)
    first = np.flatnonzero(np.diff(owner)) + 1  # the first padding of a later text and the rest of it
    for k in range(ORDER - 1):
        same[first[first + k < len(packed)] + k] = False
    return packed[same], owner[same]


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``CHUNK`` characters, with the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def count_grams(rows: DataFrame) -> DataFrame:
    """``(gram, ordinary, toxic)`` over all ``(text, toxic)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = np.empty(0, np.int64), np.empty((0, 2))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1].astype(np.int64))], names=["gram", "ordinary", "toxic"])

        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), np.asarray(batch.column(1).to_pylist(), np.int64)
            for first, chunk in _chunks(texts):
                packed, owner = grams(chunk)
                here, place = np.unique(packed, return_inverse=True)
                label = toxic[first + owner]
                mine = np.stack([np.bincount(place, 1 - label, len(here)), np.bincount(place, label, len(here))], 1)
                both, place = np.unique(np.concatenate([known, here]), return_inverse=True)
                values = np.concatenate([sums, mine])
                known, sums = both, np.stack([np.bincount(place, values[:, j], len(both)) for j in (0, 1)], 1)
                if len(known) > 1_000_000:
                    yield out()
                    known, sums = np.empty(0, np.int64), np.empty((0, 2))
        yield out()

    found = rows.select(text_or_empty().alias("text"), F.col("toxic").cast("long")).mapInArrow(run, "gram long, ordinary long, toxic long")
    return found.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


class Model:
    """Both language models: sorted grams of each table and their values."""

    #: Values of a gram that was never counted.
    UNKNOWN = {"a": [0, 0], "c": [0, 0, 1, 1], "p": [1 / ALPHABET / 100]}

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.tables = {}
        for name, (grams_, values) in counted.items():
            order = np.argsort(grams_)
            # the first row stands for all grams that are not there
            self.tables[name] = np.append(-1, grams_[order]), np.concatenate([np.array([self.UNKNOWN[name[0]]], np.float32), values[order].astype(np.float32)])

    def _values(self, name: str, wanted: np.ndarray) -> np.ndarray:
        grams_, values = self.tables[name]
        at = np.searchsorted(grams_, wanted, "right") - 1
        return values[np.where(grams_[at] == wanted, at, 0)]

    def ratios(self, packed: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each gram's last character, toxic against ordinary."""
        distinct, place = np.unique(packed, return_inverse=True)
        p = self._values("p2", distinct & ((1 << 2 * BITS) - 1))
        for n in range(3, ORDER + 1):
            gram = distinct & ((1 << n * BITS) - 1)
            above = self._values(f"c{n}", gram >> BITS)
            p = self._values(f"a{n}", gram) * above[:, :2] + above[:, 2:] * p
        logs = np.log(p)
        return (logs[:, 1] - logs[:, 0])[place]

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the ratio by its length, and the ratio's telling part by its length."""
        out = np.zeros((len(texts), 2))
        for first, chunk in _chunks(texts):
            packed, owner = grams(chunk)
            n = np.bincount(owner, minlength=len(chunk)).astype(float)
            ratios = self.ratios(packed)
            total, telling = (np.bincount(owner, x, len(chunk)) for x in (ratios, np.maximum(ratios - TELLING, 0)))
            out[first : first + len(chunk)] = np.stack([total / n, telling / n], 1)
        return out


class Judge:
    """A model that all workers have, and the curve from its features to a score."""

    def __init__(self, sent, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
        self.sent, self.curve = sent, curve

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        mean, spread, w = self.curve
        x = np.clip(np.c_[(self.sent.value.features(texts) - mean) / spread, np.ones(len(texts))] @ w, -500, 500)
        return 1 / (1 + np.exp(-x))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: means, spreads, weights with the constant last."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return mean, spread, w


def _tables(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The grams of the models' tables and their values.  What reaches the driver has one row for each distinct gram of each table."""
    kinds, level, names = [], counted, []
    zero = F.lit(0)

    def add(name: str, rows: DataFrame, key: Column, cols: list[Column], grouped: bool = False) -> None:
        names.append(name)
        cols = [c.cast("float").alias(f"v{i}") for i, c in enumerate(cols)]
        sums = rows.groupBy(key.alias("gram_")).agg(*cols) if grouped else rows.select(key.alias("gram_"), *cols)
        kinds.append(sums.select(F.lit(len(names) - 1).cast("byte").alias("kind"), "*"))

    for n in range(ORDER, 2, -1):
        seen = [F.sum((F.col(c) > 0).cast("int")) for c in ("ordinary", "toxic")]
        sums = [F.sum(c) for c in ("ordinary", "toxic")]
        add(f"a{n}", level, F.col("gram"), [F.col("ordinary"), F.col("toxic"), zero, zero])
        add(f"c{n}", level, F.shiftright("gram", BITS), [*sums, *seen], grouped=True)
        level = level.groupBy(F.col("gram").bitwiseAND((1 << (n - 1) * BITS) - 1).alias("gram")).agg(*(s.alias(c) for s, c in zip(seen, ("ordinary", "toxic"), strict=True)))
    add("p2", level, F.col("gram"), [F.col("ordinary") + F.col("toxic"), zero, zero, zero])
    found = reduce(DataFrame.unionByName, kinds).toArrow()
    kind = found.column("kind").to_numpy()
    gram, values = found.column("gram_").to_numpy(), np.stack([found.column(f"v{i}").to_numpy() for i in range(4)], 1)
    by = {name: (gram[kind == i], values[kind == i]) for i, name in enumerate(names)}
    del found
    out = {}
    for n in range(3, ORDER + 1):
        at, v = by[f"a{n}"]
        out[f"a{n}"] = at, np.maximum(v[:, :2] - DISCOUNT, 0)
        at, v = by[f"c{n}"]
        total, kinds_ = v[:, :2], v[:, 2:]
        safe = np.maximum(total, 1)
        out[f"c{n}"] = at, np.concatenate([np.where(total > 0, 1 / safe, 0), np.where(total > 0, DISCOUNT * kinds_ / safe, 1)], 1)
    at, v = by["p2"]
    _, context = np.unique(at >> BITS, return_inverse=True)
    total = np.bincount(context, v[:, 0])
    out["p2"] = at, ((v[:, 0] + FLOOR) / (total[context] + FLOOR * ALPHABET))[:, None]
    return out


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> Judge:
    """Both models and the curve, from the labelled rows outside the held-out part."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(part("id") != HELD_OUT).groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(part("id") != HELD_OUT)
    rows = texts.join(F.broadcast(known) if small else known, "id")
    last = rows.where(part("id") == CALIBRATED).select(F.xxhash64("id").alias("h")).orderBy("h").limit(calibration_rows).agg(F.max("h")).first()[0]
    sampled = F.lit(False) if last is None else (part("id") == CALIBRATED) & (F.xxhash64("id") <= last)
    began = mark()
    model = Model(_tables(materialize(count_grams(rows.where(~sampled)), "toxicity-grams")))
    discard(began)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    judged = map_texts(rows.where(sampled), "text", lambda: lambda t: [pa.array(c) for c in sent.value.features(t).T], "f0 double, f1 double")
    sample = judged.select("toxic", "f0", "f1", F.xxhash64("id").alias("h")).orderBy("h", "toxic", "f0").limit(calibration_rows).toArrow()
    x = np.stack([sample.column(f"f{i}").to_numpy() for i in range(2)], 1)
    curve = fit_curve(x, sample.column("toxic").to_numpy().astype(float)) if len(x) else None
    return Judge(sent, curve)


def score(docs: DataFrame, judge: Judge, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each text."""

    def make() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array(judge.scores(texts))]

    return map_texts(docs, text_col, make, f"`{score_col}` double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(part("doc_id") == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
