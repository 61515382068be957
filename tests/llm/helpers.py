"""Small fixtures and brute-force versions."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq


def write(folder, **tables: pa.Table) -> str:
    for name, rows in tables.items():
        pq.write_table(rows, f"{folder}/{name}.parquet")
    return str(folder)


def documents(rows: list[tuple], **extra) -> pa.Table:
    """Rows of (doc_id, text, source)."""
    cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * len(rows), pa.string()), "source": pa.array([r[2] if len(r) > 2 else "s" for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    return pa.table(cols | extra)


def duck(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql: str, folder: str) -> None:
    """The query's rows are those of its SQL."""
    names, rows = duck(sql, folder)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = Counter(repr(tuple(r[c] for c in order)) for r in df.select(*order).collect())
    want = Counter(repr(tuple(r[names.index(c)] for c in order)) for r in rows)
    assert got == want


#: Nulls, empty and long texts, ties, repeated rows, odd white space and code points.
ODD = [
    (1, "One line.\nTwo lines here.\nOne line.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "word " * 3000, "b"),
    (4, "word " * 3000, "b"),
    (5, "\t\x0b mixed\u00a0space \u2003 and ÄÖ ß ﬁ 😀 \r\n end", "c"),
    (None, "no id but a text of its own", "c"),
    (-7, "Two lines here.\nOne line.\nOne line.", None),
    (9, "x", "b"),
]


def near_classes(rows: list[tuple], similarity: float = 0.8, n: int = 5) -> dict[int, int]:
    """Classes of near copies by comparing all pairs."""
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").split()
        sets[i] = Counter(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else Counter()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    texts = {i: t or "" for i, t, *_ in rows}
    for a in ids:
        for b in ids:
            if a < b:
                both = sum((sets[a] & sets[b]).values())
                union = sum(sets[a].values()) + sum(sets[b].values()) - both
                if texts[a] == texts[b] or (union and both >= similarity * union):
                    x, y = sorted((root(a), root(b)))
                    top[y] = x
    return {i: root(i) for i in ids}
