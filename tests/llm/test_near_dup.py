"""Near duplicates against all pairs in plain Python; signatures against exact similarity."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from pagewright.llm import near_dup
from pagewright.llm.common import rows_of, saved
from pagewright.llm.near_dup import bag_signatures, components, multisets, near_duplicates, one_of_each, overlaps, shingles
from pagewright.llm.wordscan import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = (a & b).total()
    return both / max((a | b).total(), 1)


def brute(rows):
    """Class by id: copies, and links of 0.8 or more."""
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [(i, t or "", bag(t)) for i, t in rows]
    for n, (i, t, b) in enumerate(bags):
        for j, u, c in bags[:n]:
            if t == u or (b and c and jaccard(b, c) >= 0.8):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def chains(seed=11):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 9)):  # a chain of edits: neighbours are close, the ends may not be
            texts.append(" ".join(t))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
    texts += ["", None, " \n", "a", "a", "a b", "go " * 5000, "go " * 4500, "go " * 3000, "x y z " * 3000]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_classes_equal_all_pairs(spark):
    rows = chains()
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in rows], "doc_id long, text string, size int, h string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_classes_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "z"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, 1, False), (None, None, True), (None, None, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = random.Random(2)
    pairs = []
    for keep in (0.2, 0.5, 0.8, 0.95):
        base = [f"s{i}" for i in range(60)]
        a = Counter({w: rng.randint(1, 12) for w in base})
        b = Counter({w: (c if rng.random() < keep else rng.randint(1, 12)) for w, c in a.items()})
        pairs.append((a, b))
    k = 6000
    for a, b in pairs:
        key = {w: np.uint64(hash(w) & (2**64 - 1)) for w in a | b}
        h = np.array([key[w] for c in (a, b) for w in c], np.uint64)
        row = np.array([i for i, c in enumerate((a, b)) for _ in c])
        count = np.array([n for c in (a, b) for n in c.values()])
        sig = bag_signatures(h, row, count, 2, k)
        assert abs((sig[0] == sig[1]).mean() - jaccard(a, b)) < 4 * (0.25 / k) ** 0.5


def test_overlaps_equal_counters():
    rows = [t for _, t in chains(5)][:60]
    a, b = rows[:30], rows[30:]
    shared, got = overlaps(pa.array(a, pa.string()), pa.array(b, pa.string()))
    assert shared.tolist() == [(bag(x) & bag(y)).total() for x, y in zip(a, b, strict=True)]
    assert np.allclose(got, [jaccard(bag(x), bag(y)) for x, y in zip(a, b, strict=True)])
    h, row = shingles(Texts(pa.array(a, pa.string())))
    assert multisets(h, row)[2].sum() == sum(bag(t).total() for t in a)


def test_one_wide_group(spark):
    """Copies with many or few edits of one text: the lowest ids are far from all others."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randint(5, 30) if i < 60 else rng.randint(0, 7)):
            t[rng.randrange(150)] = f"e{rng.random()}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)


def test_two_close_texts_in_a_hot_bucket(spark):
    """A passage in many texts that are far apart, with lower ids, and in exactly two close ones."""
    rng = random.Random(7)
    passage = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(passage + [f"e{rng.random()}" for _ in range(30 if i < 200 else 9)])) for i in range(202)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert expected[201] == 200 and len(set(expected.values())) == 201
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == expected


def test_a_group_of_near_copies_is_not_paired_with_itself(spark, monkeypatch):
    """Edited copies of one text share buckets, and most are in classes of their own: few pairs are compared."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randint(3, 6)):
            t[rng.randrange(150)] = f"e{rng.randint(0, 300)}"
        rows.append((i, " ".join(t)))
    compared = []
    monkeypatch.setattr(near_dup, "measured", lambda pairs, texts, f=near_dup.measured: (compared.append(rows_of(pairs)), f(pairs, texts))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)
    assert compared[2] < len(rows) < compared[0], compared


def test_one_id_with_two_texts(spark):
    """An id that stands for two texts links nothing, and no text is lost."""
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (7, "alone " * 9), (None, b), (8, a), (8, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text[:1], r.class_id) for r in near_duplicates(df).join(df, "doc_id").collect() if r.doc_id != 1}
    assert got == {(5, "a", 5), (6, "b", 6), (7, "a", 7), (8, "a", 5)}
    classes = near_duplicates(df).collect()
    assert sorted(r.class_id for r in classes if r.doc_id == 1) == [5, 6] and [r.class_id for r in classes if r.doc_id is None] == [6]
    left = one_of_each(df.withColumn("h", F.lit(0)).withColumn("_h", F.lit(1))).collect()
    assert sorted(r.doc_id for r in left) == [5, 6, 7] and left[0].asDict().keys() == {"doc_id", "text", "h", "_h"}
    alike = spark.createDataFrame([(4, a), (4, a), (None, b), (None, b)], "doc_id long, text string")
    assert sorted((r.doc_id for r in one_of_each(alike).collect()), key=str) == [4, None]


def test_a_shared_id_loses_no_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:1]) for r in one_of_each(df).collect()) == [(2, "a"), (3, "b"), (4, "c")]
    assert sorted((r.doc_id, r.class_id) for r in near_duplicates(df).collect()) == [(1, 2), (1, 3), (2, 2), (3, 3), (4, 4)]
    # Two texts under one id only: both stay.
    both = one_of_each(df.where("doc_id = 1")).collect()
    assert sorted(r.text[:1] for r in both) == ["a", "b"]


def test_texts_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("pagewright.llm.near_dup.TEXT_BYTES", 0)
    monkeypatch.setattr("pagewright.llm.near_dup.SLOTS", 4)
    rows = [(i, t) for i, t in chains(21) if t][:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == brute(rows)


def test_each_text_moves_with_its_pair_only(spark, monkeypatch):
    """Beyond a broadcast a node's text goes once to all its pairs, a hub's to a few places, and every pair gets its own
    two texts, whichever of its ends is the hub and whether or not the pairs are broadcast."""
    monkeypatch.setattr(near_dup, "TEXT_BYTES", 0)
    ends = [(i, i + 1) for i in range(100, 400, 2)] + [(500, 600 + i) for i in range(90)] + [(700 + i, 501) for i in range(90)] + [(500, 501)]
    nodes = sorted({n for e in ends for n in e})
    texts = saved(spark.createDataFrame([(n, f"text {n}") for n in nodes], "node long, text string"))
    for sized in (True, False):
        pairs = saved(spark.createDataFrame([(a, b, [a]) for a, b in ends], "a long, b long, own array<long>"), sized=sized)
        tables = []
        monkeypatch.setattr(near_dup, "saved", lambda df, *rest, f=saved, **more: (tables.append(f(df, *rest, **more)), tables[-1])[1])
        both = near_dup.with_texts(pairs, texts)
        monkeypatch.setattr(near_dup, "saved", saved)
        assert sorted((r.a, r.b, r.own, r.text_a, r.text_b) for r in both.collect()) == [(a, b, [a], f"text {a}", f"text {b}") for a, b in sorted(ends)]
        # No table of texts is written, and texts go to fewer places than pairs have ends.
        assert not any("text" in t.columns for t in tables)
        places = next(t for t in tables if t.columns == ["node", "slot"])
        assert 150 + 2 < rows_of(places) <= 150 + 2 * -(-91 // near_dup.PARTNERS)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (7, 7)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert all(root in nodes for root, nodes in got.items())
    assert sorted(got.values(), key=min) == [set(range(61)), set(range(100, 140)), {200, 201}]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
