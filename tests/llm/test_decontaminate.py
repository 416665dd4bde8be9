"""Contamination against plain Python over all windows."""

import hashlib
import random
import re

import pytest

from pagewright.llm import decontaminate as dc
from pagewright.llm.decontaminate import clean_documents, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        if n:
            windows.append((i, n, {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}))
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, n, some in windows:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in some:
                    hit.update(range(j, j + n))
                    found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, item_id int, w string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b).collect()}


def made(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "é1", "x", "y", "42", "ÜBER", "z"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 8, 12, 13, 14, 20, 30])))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "y " * 40), (2, "Alpha beta x y z 42")]
    docs = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            _, t = rng.choice(items)
            part = (t or "").split()
            lo = rng.randint(0, max(0, len(part) - 1))
            w += part[lo : lo + rng.randint(1, 30)] + [rng.choice(vocab + ["q" + str(rng.random())]) for _ in range(rng.randint(0, 12))]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    return [*docs, (100, None), (101, ""), (102, "y " * 3000), (103, "!!!")], items


def test_equal_to_all_windows(spark):
    docs, items = made(4)
    assert run(spark, docs, items) == brute(docs, items)


def test_long_items_only(spark):
    docs, items = made(9)
    items = [x for x in items if len(words(x[1])) >= 13]
    assert run(spark, docs, items) == brute(docs, items)


def test_given_tables(spark):
    d = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    b = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = run(spark, d, b)
    assert got == brute(d, b)
    assert any(x[4] for x in got.values())


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def by_row(spark, docs, items):
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, h int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(d, b).collect()]
    return rows, [(r.doc_id, r.text) for r in clean_documents(d, b).collect()]


def test_rows_without_ids_or_with_one_id(spark):
    """Each row is judged by its own text."""
    item = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    docs = [(1, item), (None, item), (2, item), (2, item + " and " + other + " end"), (2, "clean text"), (None, "clean too"), (3, item), (3, item), (None, None)]
    rows, clean = by_row(spark, docs, [(1, item), (1, other), (None, other[:60])])
    want = []
    for d, t in docs:
        (x,) = brute([(d, t)], [(1, item), (1, other)]).values()
        n_items = x[2] + ("v" in (t or ""))  # the item without an id counts, and has no name
        want.append((d, x[0], x[1], n_items, x[3], x[4]))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sorted(clean, key=str) == sorted([(2, "clean text"), (None, "clean too"), (None, None)], key=str)


def test_many_places_of_a_short_item(spark):
    docs = [(1, "la " * 30_000 + "end"), (2, "no")]
    assert run(spark, docs, [(1, "la"), (2, "la la"), (3, "end")]) == brute(docs, [(1, "la"), (2, "la la"), (3, "end")])


def test_a_text_beyond_the_positions_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(dc, "POSITION_BITS", 6)
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    short, long = (spark.createDataFrame([(1, item + " x" * n)], "doc_id long, text string") for n in (44, 45))
    assert dc.contamination(short, bench).first().n_hit == 20
    with pytest.raises(Exception, match="more than 64 words"):
        dc.contamination(long, bench).collect()
