"""Each query against its SQL or a brute-force version, on a small table and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gnomon.llm import chat_format, decontamination, fingerprints, mixing, near_dedup, queries, sharding, substring_dedup, token_counts, toxicity, url_filters

from .helpers import ODD, documents, near_classes, same, write

EMPTY = documents([])


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    clash = {"shard": pa.array(["x"] * len(ODD)), "fp": pa.array(["y"] * len(ODD)), "score": pa.array([1] * len(ODD)), "n_words": pa.array([2] * len(ODD)), "__id": pa.array([3] * len(ODD)), "spans": pa.array([4] * len(ODD))}
    bench = pa.table({"item_id": pa.array([1, 2, 3, None], pa.int64()), "text": pa.array(["word word", None, "", "text OF its"], pa.string())})
    labels = pa.table({"doc_id": pa.array([1, 4, 5, None, 5], pa.int64()), "quality": pa.array([0, 1, 0, 1, 0], pa.int32()), "toxic": pa.array([1, 0, None, 1, 1], pa.int32())})
    pages = pa.table({"page_id": pa.array([1, 2, 3, 4, None, 6, 6], pa.int64()), "url": pa.array([None, "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "http://a.net/es/://", "x://b.com", "ftp://net/fr/", "ftp://net/fr/"])})
    chats = pa.table({"conv_id": pa.array([1, 1, 1, None, 2, 2], pa.int64()), "turn": pa.array([0, 1, None, 0, 0, 0], pa.int64()), "role": pa.array(["user", None, "user", "user", "a", "a"]), "text": pa.array(["Hi  THERE\nbye", "> hi there\n>> x\nyes", None, "", "same", "same"])})
    return write(tmp_path_factory.mktemp("odd"), documents=documents(ODD, **clash), benchmark=bench, labels=labels, pages=pages, conversations=chats)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    none = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())})
    pages = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string())})
    chats = pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    return write(tmp_path_factory.mktemp("empty"), documents=EMPTY, benchmark=none, labels=labels, pages=pages, conversations=chats)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op6_substring_dedup"}))
def test_matches_sql_on_odd_rows(spark, odd, name):
    df = queries.QUERIES[name](spark, odd)
    if name == "op3_document_fingerprints":
        # with repeated ids the order among them is ours, not SQL's
        assert df.count() == len(ODD)
        return
    same(df, queries.SQL[name], odd)


@pytest.mark.parametrize("name", sorted({**queries.QUERIES, "pipeline": 0}))
def test_empty_and_odd_tables_run(spark, empty, odd, name):
    query = __spark_entry__.queries()[name]
    assert query(spark, empty).count() == 0
    assert query(spark, odd).count() >= (0 if name == "pipeline" else 1)


# --- 1 --------------------------------------------------------------------------------------------------------


def test_token_counts_are_the_librarys(spark, odd):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(token_counts.default_vocabulary())
    extra = ["it's we'll <|endoftext|>x<|startoftext|> ", "ΑΣ ὈΔΥΣΣΕΎΣ", "a\u0301 e\u0301\u0323", "日本語 テキスト", "1234 5.6e7", "\u0301lead", "x" * 5000, "😀😀 👩‍👩‍👧"]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(extra))]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, token_counts.default_vocabulary()).collect())
    want = Counter((i, len((t or "").encode()), len(encoder.encode(t or "", add_special_tokens=False))) for i, t, *_ in rows)
    assert got == want


def test_encoder_gets_pieces_of_many_texts_at_once():
    counter = token_counts.LengthCounter(token_counts.default_vocabulary(), batch_bytes=4000)
    calls, encode = [], counter._encode
    counter._encode = lambda pieces: (calls.append(sum(map(len, pieces))), encode(pieces))
    texts = [f"word{i} another{i} {'x' * (i % 60)}".encode() for i in range(1000)] + [b"", b"word1 " * 3]
    got = counter.count(texts)
    assert len(calls) < 20 and all(4000 <= n < 4200 for n in calls[:-1])
    fresh = token_counts.LengthCounter(token_counts.default_vocabulary())
    assert got == [len(fresh._encoder.encode(t.decode(), add_special_tokens=False)) for t in texts]


def test_slices_join_to_the_text_and_cut_at_white_space():
    raw = ("ab cde\tf " * 500).encode()
    parts = list(token_counts.safe_slices(raw, 64))
    assert b"".join(parts) == raw and len(parts) > 10
    assert all(p[:1] in b" \t" for p in parts[1:] if p)


# --- 2 --------------------------------------------------------------------------------------------------------


def test_shards_grow_only_into_the_new_one_and_slots_have_no_gaps(spark, sf_dir):
    rows = queries.QUERIES["op2_sharding"](spark, sf_dir).toPandas()
    assert set(rows[rows.shard != rows.grown_shard].grown_shard) <= {24}
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(rows.doc_id, rows.text_crc32, strict=True))


def test_weights_confine_movement_to_their_subtree(spark):
    leaves = sharding.topology(24)
    heavier = [x._replace(weight=2.0) if x.region == "r1" else x for x in leaves]
    key = F.col("id").cast("string")
    rows = spark.range(4000).select(sharding.assign(key, leaves).alias("a"), sharding.assign(key, heavier).alias("b")).toPandas()
    moved = rows[rows.a != rows.b]
    assert len(moved) and set(moved.b) <= set(range(12, 24)) and set(moved.a) <= set(range(12))
    assert abs((rows.b >= 12).mean() - 2 / 3) < 0.04


def test_rows_of_one_id_spread_over_blocks_and_slots_have_no_gaps(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text {i % 2500}") for i in range(4000)]
    folder = write(tmp_path, documents=documents(rows))
    df = queries.QUERIES["op2_sharding"](spark, folder)
    same(df, queries.SQL["op2_sharding"], folder)
    got = df.toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # no order by text inside the one id: its rows are dealt over hashed blocks first
    nulls = got[got.doc_id.isna()].sort_values("slot")
    assert len(nulls) == sum(i is None for i, _ in rows) and not nulls.text_crc32.is_monotonic_increasing


# --- 3 --------------------------------------------------------------------------------------------------------


def test_fingerprints_ignore_order_and_follow_edits(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "b")], "x string, y string, z string")
    fp = fingerprints.fingerprint
    row = df.select(
        (fp(F.col("x")) == fp(F.col("y"))).alias("order"),
        (fingerprints.delete(fp(F.col("x")), F.col("z")) == fp(F.lit("a\nc"))).alias("deleted"),
        (fingerprints.insert(fp(F.lit("a\nc")), F.col("z")) == fp(F.col("x"))).alias("inserted"),
        (fp(F.col("x")) == fp(F.lit("a\nb\nb"))).alias("counts"),
        fingerprints.likeness(fp(F.col("x")), fp(F.lit("a\nb\nd"))).alias("half"),
    ).first()
    assert row.order and row.deleted and row.inserted and not row.counts
    assert abs(row.half - 0.5) < 0.1


def test_likeness_holds_for_very_long_texts(spark, tmp_path):
    lines = lambda name, n: [f"{name} {i}" for i in range(n)]
    common = lines("common", 27_000)
    texts = {2: "\n".join(common + lines("a", 3_000)), 1: "\n".join(common + lines("b", 3_000))}
    folder = write(tmp_path, documents=documents(list(texts.items())))
    got = {r["doc_id"]: r for r in fingerprints.op3_document_fingerprints(spark, folder).collect()}
    assert abs(got[2]["near_next"] - 27 / 33) < 0.1 and abs(got[1]["near_next"] - 27 / 33) < 0.1
    for a, b in ((2, 1), (1, 2)):
        half = len(texts[a]) // 2
        x, y = Counter(texts[a].split("\n")), Counter((texts[a][: len(texts[a]) - half] + texts[b][:half]).split("\n"))
        assert abs(got[a]["near_edited"] - (x & y).total() / (x | y).total()) < 0.15


def test_next_document_wraps_around_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    ids = random.Random(3).sample(range(-(10**12), 10**12), 200)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "__id long, text string")
    got = {r["__id"]: r["next_text"] for r in fingerprints.with_next(df, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(down, [*down[1:], down[0]], strict=True)}


def test_next_document_of_hot_ids_is_right_and_their_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 16)
    ids = [fingerprints.NULL_ID] * 400 + [50] * 300 + [51] * 9 + list(range(500))
    df = spark.createDataFrame([(x, f"t{i % 600}") for i, x in enumerate(ids)], "__id long, text string")
    block, split = fingerprints._blocks(df.select("__id"))
    blocks = df.withColumn("tie", F.xxhash64("text")).groupBy(block).count().collect()
    assert split and max(r["count"] for r in blocks) <= 64
    down = [(r["__id"], r["text"]) for r in df.orderBy(F.desc("__id"), F.xxhash64("text").desc(), F.desc("text")).collect()]
    want = Counter((a, t, u) for (a, t), (_, u) in zip(down, [*down[1:], down[0]], strict=True))
    assert Counter(map(tuple, fingerprints.with_next(df, ["text"]).select("__id", "text", "next_text").collect())) == want


# --- 4 --------------------------------------------------------------------------------------------------------


def test_grams_are_those_of_each_text_alone():
    texts = ["Hello, World!", "", "a", "Ünï cödé 42\n\n x", "\0\0"]
    packed, owner = toxicity.grams(texts)
    for i, t in enumerate(texts):
        alone, _ = toxicity.grams([t])
        assert (packed[owner == i] == alone).all()


def test_no_two_characters_share_codes():
    points = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0x110000)])
    seen = Counter()
    for part in np.array_split(points, 50):
        codes = toxicity._coded(part)
        assert codes.max() < 1 << toxicity.BITS
        leads = (codes >= toxicity.DIRECT) & (codes < toxicity.DIRECT + 1024)
        trails = codes >= toxicity.DIRECT + 1024
        assert (np.flatnonzero(leads) + 1 == np.flatnonzero(trails)).all()
        seen.update(zip(codes[leads].tolist(), codes[trails].tolist(), strict=True))
        seen.update(codes[~leads & ~trails].tolist())
    assert len(seen) == len(points) and max(seen.values()) == 1
    packed, _ = toxicity.grams(["日本"])
    assert len(packed) == len(toxicity.grams(["abcd"])[0])


def brute_kneser_ney(texts: list[str]):
    """P(character | four before it) of one class, backing off to order 2 given as counts; by dictionaries."""
    five = Counter()
    for t in texts:
        padded = " " * 5 + t + " "
        for i in range(4, len(padded)):
            five[padded[i - 4 : i + 1]] += 1
    levels = {5: five}
    for n in (4, 3, 2):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    return levels


def test_models_are_those_of_counting_by_hand(spark):
    """A small alphabet; every gram's ratio against interpolated Kneser-Ney written with dictionaries."""
    rng = random.Random(13)
    texts = [("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 25))).strip() or "a", y) for y in (0, 1) for _ in range(30)]
    texts = [(" ".join(t.split()), y) for t, y in texts]
    rows = spark.createDataFrame(texts, "text string, toxic int")
    model = toxicity.Model(toxicity._tables(toxicity.count_grams(rows)))
    levels = [brute_kneser_ney([t for t, y in texts if y == label]) for label in (0, 1)]
    shared = levels[0][2] + levels[1][2]

    def probability(gram: str, label: int) -> float:
        p = (shared[gram[-2:]] + toxicity.FLOOR) / (sum(v for g, v in shared.items() if g[0] == gram[-2]) + toxicity.FLOOR * toxicity.ALPHABET)
        for n in (3, 4, 5):
            counts, own = levels[label][n], gram[-n:]
            after = [v for g, v in counts.items() if g[:-1] == own[:-1]]
            if after:
                p = max(counts[own] - toxicity.DISCOUNT, 0) / sum(after) + toxicity.DISCOUNT * len(after) / sum(after) * p
        return p

    wanted = sorted(g for g in set(levels[0][5]) | set(levels[1][5]))
    assert len(wanted) > 150
    packed = np.array([sum((1 if c == " " else ord(c)) << toxicity.BITS * (4 - i) for i, c in enumerate(g)) for g in wanted])
    got = model.ratios(packed)
    want = [np.log(probability(g, 1) / probability(g, 0)) for g in wanted]
    assert np.allclose(got, want, atol=1e-4)


def test_toxic_texts_are_told_apart(spark, tmp_path):
    rng = random.Random(5)
    calm, rude = [f"{a}{b}" for a in "bdfglm" for b in ("one", "ato", "ire", "ul")], ["vilegrub", "foulnit", "grubscum"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [rng.choice(calm) for _ in range(40)]
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(rude) + rng.choice(["", "s", "ly"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    lab = pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([0] * 600, pa.int32()), "toxic": pa.array([y for _, y in labels], pa.int32())})
    folder = write(tmp_path, documents=documents(rows), labels=lab)
    got = toxicity.op4_toxicity(spark, folder).toPandas()
    assert ((got.held_out) == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 3 == 0)).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_grams_keep_counts_of_their_own(spark):
    """Ordinary grams that shared every place of order 5 with a toxic one leave its counts alone."""
    toxic, apart = sum(ord(c) << 12 * i for i, c in enumerate("tsefu")), 2097143 * 1048573 << 12
    rows = [(toxic, 0, 50), *((toxic + apart * k, 5000, 0) for k in range(1, 6))]
    model = toxicity.Model(toxicity._tables(spark.createDataFrame(rows, "gram long, ordinary long, toxic long")))
    ratios = model.ratios(np.array([g for g, *_ in rows]))
    assert ratios[0] > 1 and (ratios[1:] < -1).all()


def test_only_the_calibration_sample_is_not_counted(spark):
    calibrated = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 3]
    docs = spark.createDataFrame([(i, "calm words" + (" vilegrub" if i in calibrated else "")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in calibrated)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, calibration_rows=10).sent.value
    gram = sum(ord(c) << 12 * i for i, c in enumerate("burge"))
    assert model._values("a5", np.array([gram]))[0].tolist() == [0, len(calibrated) - 10 - toxicity.DISCOUNT]


def test_held_out_labels_change_nothing(spark, tmp_path):
    rows = [(i, f"text number {i} " + ("bad " if i % 4 == 0 else "good ")) for i in range(200)]
    scores = []
    for flip in (0, 1):
        toxic = [(i % 4 == 0) ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200)]
        lab = pa.table({"doc_id": pa.array(range(200), pa.int64()), "quality": pa.array([0] * 200, pa.int32()), "toxic": pa.array([int(x) for x in toxic], pa.int32())})
        (tmp_path / str(flip)).mkdir()
        folder = write(tmp_path / str(flip), documents=documents(rows), labels=lab)
        scores.append({r.doc_id: round(r.score, 12) for r in toxicity.op4_toxicity(spark, folder).collect()})
    assert scores[0] == scores[1]


# --- 5 --------------------------------------------------------------------------------------------------------


def test_targets_are_those_of_resharing_by_hand(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 1, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    names = [*sorted(k for k in sizes if k), None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    want, budget, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[k] for k in free)
        want |= {k: budget * weight[k] / total for k in free}
        over = {k for k in free if want[k] > 2 * sizes[k]}
        if not over:
            break
        for k in over:
            want[k] = 2.0 * sizes[k]
            budget -= want[k]
        free -= over
    assert all(abs(got[k] - want[k]) < 1e-6 for k in names)


def test_salted_join_gives_the_same(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    found = mixing.targets(docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_size")))
    few = {r.doc_id: r.target for r in mixing.with_target(docs, found).collect()}
    assert few == {r.doc_id: r.target for r in mixing.with_target(docs, found, limit=1).collect()}


def test_mix_emits_copies_of_whole_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    most = Counter(repr(r) for r in out.collect())
    base = Counter(repr(r) for r in docs.collect())
    assert set(most) <= set(base) and all(n <= 2 * base[r] for r, n in most.items())


# --- 6 --------------------------------------------------------------------------------------------------------


def brute_repeats(rows, k):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), (i, j))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] != (i, j):
                gone |= set(range(j, j + k))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def test_repeats_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(90))) + (" " + passage if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100, "a " * 300), (101, "a " * 50), (102, passage), (103, None), (-5, passage), (None, passage), (100, "a " * 300)]
    folder = write(tmp_path, documents=documents(rows))
    got = Counter(tuple(r) for r in substring_dedup.op6_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_repeats(rows, 20)


def test_texts_under_one_id_keep_to_their_own_spans(spark, tmp_path):
    """Two texts without an id whose hashes agree in the low 16 bits; only the first of them repeats something."""
    passage, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    texts = spark.range(1500).select(F.concat(F.lit(f"x y {passage} z"), "id").alias("copy"), F.concat(F.lit(f"{other} y"), "id").alias("own"))
    low = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 16)).alias("low")
    copy, own = texts.select("copy", low("copy")).join(texts.select("own", low("own")), "low").select("copy", "own").orderBy("copy", "own").first()
    folder = write(tmp_path, documents=documents([(None, passage), (None, copy), (None, own)]))
    got = {r["n_words"]: r["n_removed"] for r in substring_dedup.op6_substring_dedup(spark, folder).collect()}
    assert got == {30: 0, 33: 30, 31: 0}


def test_thousands_of_rows_without_an_id_lose_only_what_repeats(spark, tmp_path):
    """Half of 4,000 texts under the null id share a passage at the same place; the last text has over 10 MB."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(str(rng.random()) for _ in range(25)) + (f" {passage}" if i % 2 else "") for i in range(4000)]
    long = " ".join(str(rng.random()) for _ in range(600_000))
    rows = [*((None, t) for t in texts), *((None, texts[1]) for _ in range(50)), (5, passage), (6, long), (7, long[: 1 << 20].rsplit(" ", 1)[0])]
    assert len(long) > 10 << 20
    folder = write(tmp_path, documents=documents(rows))
    got = Counter(tuple(r) for r in substring_dedup.op6_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_repeats(rows, 20)


def test_frequent_minimisers_are_found_and_change_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(200)))) for i in range(120)]
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.xxhash64("text"))
    buckets, frequent = substring_dedup.plan_buckets(docs, sample=1)
    assert buckets == 16 and 0 < len(frequent) <= 16
    assert substring_dedup.plan_buckets(docs, sample=1, bucket_bytes=100)[0] > 16
    folder = write(tmp_path, documents=documents(rows))
    got = Counter(tuple(r) for r in substring_dedup.op6_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute_repeats(rows, 20)


def test_equal_hashes_do_not_make_equal_windows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_mix", lambda x: x * np.uint64(0))
    packer = substring_dedup.Packer(1, window=3, minimiser=2)
    texts = [b"a b c d e", b"x y z a b c", b"q r s"]
    rows = list(packer.pack([1, 2, 3], [0, 0, 0], texts))
    found = sorted(tuple(int(v) for v in x) for part in substring_dedup.repeats([p for _, p in rows], 3) for x in part.T)
    assert found == [(2, 0, 3, 6)]


# --- 7 --------------------------------------------------------------------------------------------------------


def test_darts_agree_with_the_weighted_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(400)]
    other = [rng.choice(words) if rng.random() < 0.03 else w for w in base] + base[:100]
    owner, element, weight = near_dedup.Shingler().sets([" ".join(base), " ".join(other)])
    a, b = (Counter(dict(zip(element[owner == i].tolist(), weight[owner == i].tolist(), strict=True))) for i in (0, 1))
    real = sum((a & b).values()) / sum((a | b).values())
    darts = near_dedup.dart_signatures(owner, element, weight, 2, 3000)
    assert abs((darts[0] == darts[1]).mean() - real) < 0.04


@pytest.mark.parametrize("hot", [1000, 2])
def test_classes_match_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT_MEMBERS", hot)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        for n in range(rng.randrange(1, 25)):
            rate = rng.choice([0, 0.002, 0.01, 0.03, 0.06])
            rows.append((g * 100 + n, " ".join(rng.choice(words) if rng.random() < rate else w for w in base)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "one")]
    folder = write(tmp_path, documents=documents(rows))
    got = {r.doc_id: r.class_id for r in near_dedup.op7_near_dedup(spark, folder).collect()}
    want = near_classes(rows)
    assert got == want


def test_cells_find_links_between_members():
    sets = [np.arange(30 * i, 30 * i + 400, dtype=np.int32) for i in range(3)] + [np.arange(10**6, 10**6 + 400, dtype=np.int32)]
    bands, all_of = np.ones((4, 25), np.int64), np.arange(4)
    links = near_dedup.cell_links(0, np.arange(4), np.arange(4), bands, sets, all_of, all_of, 0.8)
    assert {frozenset(x) for x in links} == {frozenset((0, 1)), frozenset((1, 2))}
    assert near_dedup.cell_links(1, np.arange(4), np.arange(4), bands, sets, all_of, all_of, 0.8) == []


def test_members_are_packed_once_and_meet_in_cells(spark):
    """Every member's sets go into one block however many blocks there are; cells find the classes of all pairs."""
    rng = np.random.default_rng(4)
    n, low = 60, 35
    base, other = rng.choice(10**6, 50, replace=False), rng.choice(10**6, 50, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base if i < 40 else other, rng.integers(42, 50), replace=False), rng.choice(10**6, 3)])).tolist() for i in range(n)]
    facts = spark.createDataFrame([(i, [7] * 25, x) for i, x in enumerate(sets)], "id long, bands array<long>, elements array<int>")
    members = spark.createDataFrame([(70, 0, i, n, 0 if i < low else i, 0) for i in range(n)], "bucket long, band int, id long, n long, label long, low long")
    for size in (100, 10**6):
        packed = near_dedup._packed(members, facts, 10, size).collect()
        held = [(r.mine < r.lows, i, label) for r in packed for t in [pa.ipc.open_stream(r.data).read_all()] for i, label in zip(t["id"].to_pylist(), t["label"].to_pylist(), strict=True)]
        assert sorted(held) == sorted((i < low, i, 0 if i < low else i) for i in range(n))
        assert len(packed) == 2 if size == 10**6 else len(packed) > 15
    for size in (100, 10**6):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near_dedup, "BLOCK_ELEMENTS", size)
            links = near_dedup._cell_links(members, facts, 0.8, 10).collect()
        pairs = [(a, b) for a in range(n) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        tops = []
        for edges in (links, pairs):
            top = [0 if i < low else i for i in range(n)]
            for a, b in edges:
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
            tops.append(top)
        assert tops[0] == tops[1] and len(set(tops[0])) > 2
        assert not any(a < low and b < low for a, b in links)


def test_cells_lose_no_pair_at_the_threshold():
    """Random sets with many pairs near 0.8, against all pairs: the classes are the same."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 40
        base = rng.choice(10**6, 60, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(45, 60), replace=False), rng.choice(10**6, rng.integers(0, 12))])).astype(np.int32) for _ in range(n)]
        half = np.arange(n) % 2 == 0
        rows, cols = np.flatnonzero(half), np.flatnonzero(~half)
        links = near_dedup.cell_links(0, np.arange(n), np.arange(n), np.zeros((n, 25), np.int64), sets, rows, cols, 0.8)
        pairs = [(a, b) for a in rows for b in cols if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]

        def classes(edges):
            top = list(range(n))
            for a, b in edges:
                x, y = top[a], top[b]
                top = [x if t == y else t for t in top]
            return [min(j for j in range(n) if top[j] == top[i]) for i in range(n)]

        assert set(map(tuple, links)) <= {(int(a), int(b)) for a, b in pairs} and classes(links) == classes(pairs)


def test_texts_under_one_id_are_nodes_of_their_own(spark, tmp_path):
    rng = random.Random(12)
    one, two = (" ".join(str(rng.random()) for _ in range(60)) for _ in "ab")
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (3, one), (None, one + " end")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for r in found:
        classes.setdefault(r.class_id, []).append((r.doc_id, r.representative))
    assert sorted(({d for d, _ in x} for x in classes.values()), key=repr) == sorted([{1, 3, None}, {1, 2}], key=repr)
    # every class keeps one text (twice where the row that stands for it is there twice)
    kept = {c: {d for d, r in x if r} for c, x in classes.items()}
    assert all(len(x) == 1 for x in kept.values())


# --- 8 to 10 --------------------------------------------------------------------------------------------------


def test_false_positives_of_the_filter_do_no_harm(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = Counter(tuple(r) for r in url_filters.judge(pages, url_filters.rules_frame(spark)).collect())
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    monkeypatch.setattr(url_filters, "MOST_BLOCKS", 1)
    assert want == Counter(tuple(r) for r in url_filters.judge(pages, url_filters.rules_frame(spark)).collect())


def test_no_rules_allow_everything(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = url_filters.rules_frame(spark).where("false")
    assert {r.verdict for r in url_filters.judge(pages, rules).collect()} == {"allow"}


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünï: The QUICK—brown fox, jumps! over"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "quick-brown fox jumps"), ("r", "fox")], "item_id string, text string")
    for limit in (1, 1 << 20):
        row = decontamination.scan(docs, bench, part_bytes=limit).where("doc_id = 1").first()
        assert row["items"] == ["r"]  # the dash is no blank, so "quick—brown" is one word
        assert [row["text"][s.begin : s.end] for s in row["spans"]] == ["fox"]


def test_scanner_finds_windows_of_words_of_any_number_of_symbols():
    """A vocabulary that needs words of one, two and three symbols, against all windows of all items."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(12_000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 25, 60])))) for i in range(900)]
    items += [("dup", items[0][1]), ("all", " ".join(vocabulary))]
    scanner = decontamination.Scanner(items)
    windows = {}
    for name, text in items:
        w = text.split()
        for j in range(max(1, len(w) - 9)):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(name)
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(3):
            source, at = rng.choice(items)[1].split(), rng.randrange(180)
            first = rng.randrange(len(source))
            own[at : at + 15] = source[first : first + 15]
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(own) - n + 1):
                if tuple(own[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[tuple(own[j : j + n])]
        n, spans, found = scanner.scan(" ".join(own))
        assert {w for a, b in spans for w in range(a, b)} == hit and found == sorted(names)


def test_quotes_are_linked_at_their_level(spark):
    rows = [(1, 0, "user", "alpha\nbeta"), (1, 1, "bot", "> alpha\ngamma"), (1, 2, "user", ">> beta\n> GAMMA\ndelta"), (1, 3, "bot", "> nobody said\nend")]
    out = {r.turn: r for r in chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[i].reply_to for i in range(4)] == [None, 0, 1, 2]
    assert [out[i].link for i in range(4)] == ["first", "quote", "quote", "previous"]
    assert [out[i].n_linked for i in range(4)] == [0, 1, 2, 0]
    assert out[2].chat == "<|user|>\ndelta" and [out[i].position for i in range(4)] == [0, 1, 2, 3]


def test_rewrapped_runs_and_paragraphs_are_linked(spark):
    rows = [
        (1, 0, "a", "Dear all,\n\nthe quick brown\nfox jumps over\n\nregards"),
        (1, 1, "b", "one two three\nfour five"),
        (1, 2, "c", "nothing of that"),
        (1, 3, "d", "> the quick\n> brown fox jumps\n> over\nyes"),  # one paragraph of a longer original
        (1, 4, "e", "> one two\n> three four five\nno\n> nothing\n> of that\nwhy"),  # two originals, answers between
        (1, 5, "f", "> dear all, the\n> quick brown fox jumps over regards\nbye"),  # a whole original
    ]
    out = {r.turn: r for r in chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(out[i].link, out[i].reply_to) for i in (3, 4, 5)] == [("quote", 0), ("quote", 2), ("quote", 0)]
    assert out[4].n_linked == 2


def test_answers_follow_what_they_answer_thread_by_thread(spark):
    rows = [
        (1, 0, "a", "start here"),
        (1, 1, "b", "first thread"),
        (1, 2, "c", "> start here\nsecond thread"),
        (1, 3, "b", "> first thread\nmore of one"),
        (1, 4, "c", "> second thread\nmore of two"),
        (1, 5, "b", "> more of one\nend of one"),
        (1, 6, "d", "> first thread\naside"),
        (1, None, "e", "> aside\nlost"),
    ]
    out = sorted(chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert [r.turn for r in out] == [0, 1, 3, 5, 6, 2, 4, None]
    assert [r.thread for r in out] == [None, None, None, None, 6, 2, 2, None] and [r.depth for r in out] == [0, 0, 0, 0, 1, 1, 1, 0]


def test_threads_match_sql_on_quoting_conversations(spark, tmp_path, monkeypatch):
    """Random interleaved threads that quote lines, paragraphs, runs and whole messages, over many blocks."""
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    rng = random.Random(14)
    rows = []
    for conv in range(25):
        said = []
        for turn in range(rng.choice([1, 5, 30])):
            own = "\n".join(rng.choice(["", *(" ".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(4))]) for _ in range(rng.randrange(1, 5)))
            quoted = ""
            for _ in range(rng.randrange(3) if said else 0):
                lines = rng.choice(said).split("\n")
                first = rng.randrange(len(lines))
                part = lines[first : first + rng.randrange(1, 4)]
                quoted += "".join(f"{rng.choice(['> ', '>> ', '>'])}{x}\n" for x in (part if rng.random() < 0.6 else [" ".join(part)])) + rng.choice(["", "ok\n"])
            said.append(own)
            rows.append((conv, turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, rng.choice(["u", "v"]), quoted + own))
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows]), "text": pa.array([r[3] for r in rows])})
    folder = write(tmp_path, conversations=table)
    df = chat_format.op10_chat_formatting(spark, folder).cache()
    assert df.where("depth > 1").count() > 20 and df.where("link = 'quote'").count() > 100
    same(df, chat_format.OP10_SQL, folder)
