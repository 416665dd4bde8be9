"""Ranked search against scoring every document, and the index's blocks and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pagewright.llm import lexical_search as ls

UP = str.maketrans(ls._UP, ls._LOW)


def terms(text):
    return re.findall(ls.TERMS, (text or "").translate(UP))


def brute(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        best = []
        for doc, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                best.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r + 1, b[3], -b[0]) for r, b in enumerate(sorted(best)[:k])]
    return sorted(out, key=str)


def made(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"é{k}" if k % 3 else f"W{k}" for k in range(300)]
    word = lambda: vocabulary[min(299, int(rng.paretovariate(0.7)) - 1)]
    text = lambda most: "".join(word() + rng.choice([" ", "-", "_x_", "\n", ". "]) for _ in range(rng.randint(0, most)))
    docs = [(rng.randint(0, 2 * n) if k % 9 else None, text(rng.choice([5, 60, 400]))) for k in range(n)]
    docs += [(7, None), (8, ""), (9, "!?"), (10, "é2 " * 70_000), (11, "w3 " * 300 + "é1"), *[(1000 + k, "é4 W3 é50") for k in range(40)], *[(5, "W3 é7")] * 3]
    items = [(k, text(40)) for k in range(12)] + [(0, "é1 é2 é2 unknown"), (None, "w3 W3"), (3, None), (4, "..."), (5, "é4 é50"), (5, "é4 é50")]
    return docs, items


def run(spark, docs, items, k=20, **sizes):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = ls.search(ls.build_index(d, **sizes), q, k) if sizes else ls.ranked_documents(d, q, k)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str)


def test_equal_to_scoring_all(spark):
    docs, items = made(1)
    assert run(spark, docs, items) == brute(docs, items)


def test_many_small_shards_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BLOCK", 3)
    docs, items = made(2)
    assert run(spark, docs, items, k=5, pairs=300, most_docs=40) == brute(docs, items, 5)
    monkeypatch.setattr(ls, "small_side", lambda df, *a, **b: df)
    assert run(spark, docs, items, k=3, pairs=500) == brute(docs, items, 3)


def shard_of(docs):
    shard = ls.Shard()
    shard.add(pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs]))
    return shard.packed(0).to_pylist()


def test_blocks_that_cannot_matter_stay_packed():
    rng = np.random.default_rng(5)
    often = rng.choice(3, 20_000, p=[0.6, 0.3, 0.1]) + 1
    docs = [(k, "the " * int(often[k]) + "of " * int(often[-k]) + ("rare" if k % 997 == 0 else "") + " x" * (k % 50)) for k in range(20_000)]
    rows = shard_of(docs)
    lengths = np.asarray(rows[-1]["lengths"])
    m_of = lambda x: 75 + (25 * x * len(docs)) // int(lengths.sum())
    m = m_of(lengths)
    lists = {r["term"]: ls.Postings(r, m_of, m) for r in rows[:-1]}
    asked = [(9000, lists["rare"]), (20, lists["the"]), (10, lists["of"])]
    best, score = ls.top_places(asked, len(docs), np.arange(len(docs)), 10)
    every = np.zeros(len(docs), np.int64)
    share = {t: p.open.mean() for t, p in lists.items()}
    for w, p in asked:
        every[p.place[p.between(0, len(docs))]] += w * p.impact
    first = np.lexsort((np.arange(len(docs)), -every))[:10]
    assert sorted(zip(-score, best, strict=True)) == sorted(zip(-every[first], first, strict=True))
    assert share["rare"] == 1 and 0 < share["the"] < 0.8 and 0 < share["of"] < 0.8


def test_packing_keeps_every_posting_and_bounds_hold():
    docs, _ = made(3, 3000)
    rows = shard_of(docs)
    counts = [Counter(terms(t)) for _, t in docs]
    lengths = np.array([sum(c.values()) for c in counts])
    assert rows[-1]["lengths"] == lengths.tolist() and rows[-1]["ids"] == [i for i, _ in docs]
    m_of = lambda x: 75 + x // 3
    m = m_of(lengths)
    for r in rows[:-1]:
        p = ls.Postings(r, m_of, m)
        bounds = p.bounds(np.arange(len(docs)))
        p.between(0, len(docs))
        where = [k for k, c in enumerate(counts) if r["term"] in c]
        assert p.place.tolist() == where and r["n"] == len(where)
        exact = ls.impact(np.array([counts[k][r["term"]] for k in where]), m[where])
        assert (p.impact == exact).all() and (bounds[where] >= exact).all()
        assert p.top == exact.max()  # bounds are reached


def test_empty_tables(spark):
    docs, items = made(4, 20)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None), (2, "?")], items) == []
    wide = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id int, text string, term string, score long")
    got = ls.ranked_documents(wide, spark.createDataFrame([(1, "b", 0), (2, "c", 0)], "item_id int, text string, query int")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(1, 1, 1)]
