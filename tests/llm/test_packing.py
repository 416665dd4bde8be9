"""Packing against the tokenizer library, exact cover, and a quadratic search for the best cuts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm.packing import WINDOW, best_cuts, pack, tail_lengths
from pagewright.llm.tokens import encode

HARD = [None, "", " ", "a", "it's  two\n\n lines\t\tand <|endoftext|> ünï 😀 don't", " " * 20_000, "x" * 20_000, "7" * 9_000, "!" * 9_000, "word " * 300_000, "a b   c"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer_library(plain, spark):
    texts = [*HARD, *[r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]]
    for t in texts:
        assert encode(t or "").tolist() == plain(t)


def check(rows, texts, plain):
    pieces, sequences, padding, total = defaultdict(list), defaultdict(list), 0, 0
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for k, got in pieces.items():
        ids = np.array([*plain(texts[k]), 1], "<u4")
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= WINDOW
        padding += 0 if at & (at - 1) == 0 else WINDOW - at
        total += at
    return padding / total


def test_every_id_once_with_little_padding(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    assert check(pack(df).collect(), texts, plain) < 0.01


def test_odd_texts(spark, plain):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(HARD)], "doc_id long, text string, start int").repartition(3)
    check(pack(df).collect(), dict(enumerate(HARD)), plain)
    assert pack(df.limit(0)).count() == 0
    one = spark.createDataFrame([(None, "hello"), (None, "hello")], "doc_id long, text string")
    assert sum(r.length for r in pack(one).collect()) == 2 * (len(plain("hello")) + 1)


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        window = rng.choice([8, 16, 64])
        place = np.cumsum([rng.randint(1, window // 2) for _ in range(rng.randint(1, 60))])
        cost = np.array([rng.choice([0.0, 1.0, 5.0]) for _ in place])
        pos, f = [0, *place], [0.0]
        for j in range(1, len(pos)):
            f.append(min(f[i] + window - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= window) + cost[j - 1])
        cuts = best_cuts(place, cost, window)
        steps = np.diff([0, *cuts])
        assert steps.max() <= window and cuts[-1] == place[-1]
        assert abs(sum(window - steps) + sum(cost[np.searchsorted(place, cuts)]) - f[-1]) < 1e-9


def test_tails():
    assert all(sum(tail_lengths(n)) == n for n in range(1, WINDOW + 1))
    assert tail_lengths(100) == [64, 32, 4] and tail_lengths(2047) == [2047] and tail_lengths(1024) == [1024]
