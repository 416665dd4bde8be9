"""Quality counts against plain Python, EM on votes with a known truth, held-out labels."""

import random
import re

import numpy as np
import pyarrow as pa

from pagewright.llm.weak_quality import RULES, evidence, fit, judge, measure, quality_digest

DATA = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + d for at in where.values() if len(at) > 1 for i in at for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def texts():
    rng = random.Random(3)
    bits = ["a", "bb", "é😀", "#", "$x", " ", "  ", "\n", "\t", "\x0b", " ", "the", "of", "\r\n", "|"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return [*made, None, "", " \n ", "x" * 300_000, "go " * 60_000, "same line\n" * 500, "\n" * 1000 + "a b c"]


def test_counts_equal_plain_python(spark):
    own = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, n_words int")
    df = own.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 10000", "text"))
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    rows = quality_digest(df).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert quality_digest(own).count() == len(texts())
    assert quality_digest(own.limit(0)).count() == 0


def test_lines_and_words_that_share_a_hash():
    """Texts for which any polynomial over bytes modulo 2**64 agrees are not equal lines or words."""
    u = "a"
    for _ in range(11):
        u += u.translate(str.maketrans("ab", "ba"))
    v = u.translate(str.maketrans("ab", "ba"))
    got = measure(pa.array([f"{u}\n{v}\n{u}", f"{u} x y {v} x y", None]))
    assert got["n_dup_lines"].tolist() == [1, 0, 0] and got["n_repeat_words"].tolist() == [0, 0, 0] and got["n_distinct"].tolist() == [2, 4, 0]


def simulated(truth, share, n=60_000, seed=5, silent=0.2):
    """Counted patterns of independent votes, and for each pattern its number of good and bad documents."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    votes = np.where(rng.random((n, len(truth))) < truth[:, good.astype(int)].T, 0, 1)
    votes[rng.random(votes.shape) < silent] = -1
    found, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return [(tuple(map(int, p)), int(c)) for p, c in zip(found, count, strict=True)], found, np.bincount(at, weights=good), count


def odds_of(prior, rates, patterns):
    return np.log(prior / (1 - prior)) + evidence(rates, patterns >= 0, patterns == 0)


def test_em_finds_the_rates_of_its_rules():
    truth = np.array([[0.7, 0.002], [0.5, 0.02], [0.6, 0.05], [0.4, 0.003], [0.8, 0.01]])
    counted, *_ = simulated(truth, 0.8)
    prior, rates = fit(counted, 5)
    assert abs(prior - 0.8) < 0.02 and abs(rates - truth).max() < 0.03


def test_a_rule_that_errs_is_found_out_and_outvoted():
    """One rule votes bad on a tenth of the good documents: its lone bad votes lose, two bad votes of others win."""
    truth = np.array([[0.7, 0.002], [0.6, 0.004], [0.6, 0.10], [0.5, 0.003], [0.7, 0.002]])
    counted, patterns, good, count = simulated(truth, 0.85)
    prior, rates = fit(counted, 5)
    assert 0.08 < rates[2, 1] < 0.12
    odds = odds_of(prior, rates, patterns)
    lone = (patterns == [1, 1, 0, 1, 1]).all(1)
    assert lone.any() and (odds[lone] > 0).all()
    assert (odds[(patterns == [0, 0, 1, 1, 1]).all(1)] < 0).all()
    assert good[odds > 0].sum() > 0.99 * good.sum() and (count - good)[odds < 0].sum() > 0.9 * (count - good).sum()


def test_fit_at_any_size():
    truth = np.array([[0.7, 0.01], [0.6, 0.02], [0.6, 0.05], [0.5, 0.01], [0.7, 0.01], [0.4, 0.03]])
    counted, patterns, good, count = simulated(truth, 0.9)
    for scale in (1, 10**6):
        odds = odds_of(*fit([(p, c * scale) for p, c in counted], 6), patterns)
        assert good[odds > 0].sum() > 0.98 * good.sum()
    prior, rates = fit([((1,) * 6, 5)], 6)
    assert odds_of(prior, rates, np.array([[1] * 6]))[0] > 0 and fit([], 6)[0] > 0.5


def test_verdict_is_not_all_must_pass(spark):
    rows = judge(spark.read.parquet(f"{DATA}/documents.parquet")).where("not base_failed").collect()
    bad = lambda r: [k for k in RULES if r[f"vote_{k}"] == 0]
    lone, two = [r for r in rows if len(bad(r)) == 1], [r for r in rows if len(bad(r)) == 2]
    assert sum(r.kept for r in lone) >= 10 and sum(not r.kept for r in two) >= 10
    assert all(r.kept for r in rows if not bad(r))


def test_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = judge(docs).select("doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean)
    assert sum(bad) <= 0.1 * len(bad)
    assert 8 <= len(RULES) <= 12
