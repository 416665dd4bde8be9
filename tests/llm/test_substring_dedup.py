"""Repeated windows against plain Python over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = 35


def brute(rows):
    texts = {i: WORD.findall(t or "") for i, t in rows}
    count = Counter(tuple(w[j : j + N]) for w in texts.values() for j in range(len(w) - N + 1))
    out = {}
    for i, w in texts.items():
        gone = {j + d for j in range(len(w) - N + 1) if count[tuple(w[j : j + N])] > 1 for d in range(N)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "m") for i, t in rows], "doc_id long, text string, start int, mini string")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.deduplicate(df).collect()}


def made(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"é{rng.randint(0, 10**6)}" for _ in range(n)]
    shared = [fresh(rng.choice([20, 34, 35, 36, 60, 200])) for _ in range(8)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            lo = rng.randint(0, 5)
            w += fresh(rng.randint(0, 50)) + p[lo : len(p) - rng.randint(0, 5)]
        rows.append((d, "".join(x + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for x in w)))
    return [*rows, (500, None), (501, ""), (502, "go " * 3000), (503, "a b c " * 500), (504, " ".join(fresh(34))), (505, rows[7][1]), (506, "go " * 36), (507, "x " * 35)]


def test_equal_to_all_windows(spark):
    rows = made(3)
    assert run(spark, rows) == brute(rows)


def test_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET_ROWS", 2)
    rows = made(8)
    assert run(spark, rows) == brute(rows)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    short = " ".join(f"s{i}" for i in range(34))
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " end"), (2, "a b"), (3, short), (3, short)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in sd.deduplicate(df).collect())
    assert got == [("1", 80, 80), ("1", 80, 80), ("2", 2, 0), ("3", 34, 0), ("3", 34, 0), ("None", 81, 80)]
    # Rows alike in id and text are two documents.
    assert [r.n_removed for r in sd.deduplicate(df.where("doc_id = 1")).collect()] == [80, 80]
    alike = spark.createDataFrame([(None, short + " x y"), (None, short + " x y"), (5, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in sd.deduplicate(alike).collect()) == [0, 36, 36]
    assert sd.deduplicate(df.limit(0)).count() == 0


def test_words_that_share_a_hash(spark):
    """Two long words for which any polynomial over bytes modulo 2**64 agrees are different words."""
    u = "a"
    for _ in range(11):
        u += u.translate(str.maketrans("ab", "ba"))
    v = u.translate(str.maketrans("ab", "ba"))
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([u, *rest])), (2, " ".join([v, *rest])), (3, " ".join([u, *rest]))]
    assert run(spark, rows) == brute(rows)


def test_texts_are_not_written_between_steps(spark, monkeypatch):
    """Steps write narrow rows only, and each table once: every file costs its executor further processes."""
    tables = []
    monkeypatch.setattr(sd, "saved", lambda df, save=sd.saved, **how: tables.append(df.columns) or save(df, **how))
    rows = made(5)
    assert run(spark, rows) == brute(rows)
    assert tables == [["did", "rid", "run"], ["did", "rid"], sd.FOUND_NAMES, ["did", "rid", "ranges"]]


@pytest.mark.parametrize("n", [1, 3, 28])
def test_sliding_min(n):
    x = np.random.default_rng(n).integers(0, 1000, 200).astype(np.uint64)
    assert (sd.sliding_min(x, n) == [x[i : i + n].min() for i in range(200 - n + 1)]).all()
