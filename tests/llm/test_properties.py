"""Properties on random inputs, without Spark."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gnomon.llm import decontamination, near_dedup, substring_dedup, token_counts

words = st.lists(st.sampled_from(["a", "b", "cc", "ä", "😀"]), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, min_size=1, max_size=8), st.integers(1, 3), st.booleans(), st.sampled_from([4, 12]), st.sampled_from([1, 40, 1 << 20]))
def test_packed_windows_repeat_as_counted(docs, minimiser, split, k, most_bytes):
    texts = [" ".join(d).encode() for d in docs]
    half = len(texts) // 2
    frequent = substring_dedup.Packer(1, k, minimiser).count(texts)[0] if split else None
    buckets = {}
    for part in (range(half), range(half, len(texts))):
        packer = substring_dedup.Packer(3, k, minimiser, frequent)
        for bucket, payload in packer.pack(list(part), [0] * len(part), [texts[i] for i in part]):
            buckets.setdefault(bucket, []).append(payload)
    gone = [set() for _ in docs]
    for payloads in buckets.values():
        for found in substring_dedup.repeats(payloads, k, most_bytes):
            for doc, _, first, past in found.T.tolist():
                gone[doc] |= set(range(first, past))
    first_at, want = {}, [set() for _ in docs]
    for i, d in enumerate(docs):
        for j in range(len(d) - k + 1):
            if first_at.setdefault(tuple(d[j : j + k]), (i, j)) != (i, j):
                want[i] |= set(range(j, j + k))
    assert gone == want


@settings(max_examples=60, deadline=None)
@given(words, st.lists(words, max_size=4), st.integers(1, 5))
def test_scanner_finds_every_window(doc, items, size):
    scanner = decontamination.Scanner([(str(i), " ".join(x)) for i, x in enumerate(items)], size)
    own = decontamination.words(" ".join(doc))
    hit, found = set(), set()
    for i, x in enumerate(items):
        w = decontamination.words(" ".join(x))
        wins = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
        for win in wins:
            for j in range(len(own) - len(win) + 1):
                if tuple(own[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(i))
    n, spans, ids = scanner.scan(" ".join(doc))
    assert n == len(own) and {w for a, b in spans for w in range(a, b)} == hit and ids == sorted(found)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=300), st.integers(1, 40))
def test_slices_never_cut_a_word(text, size):
    raw = text.encode()
    parts = list(token_counts.safe_slices(raw, size))
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


@settings(max_examples=30, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_signatures_do_not_depend_on_the_batch(docs):
    texts = [" ".join(d) for d in docs]
    shingler = near_dedup.Shingler()
    together = near_dedup.dart_signatures(*shingler.sets(texts), len(texts), 30)
    for i, t in enumerate(texts):
        assert (near_dedup.dart_signatures(*shingler.sets([t]), 1, 30)[0] == together[i]).all()
    assert together.dtype == np.uint64
