"""Quality by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

One pass over the texts gives a narrow feature table, written once; votes have at most 3**rules patterns, whose
counts over all documents are all that EM sees, so the driver holds a few thousand numbers at any corpus size.

Rules look at overlapping sides of a text, so most defects draw several votes. A rule's rates of bad votes on bad and
on good documents are free: they come from the company its votes keep, with a prior worth ``PRIOR_DOCS`` documents.
So one bad vote of a rule that errs often is outvoted, and two mild ones may decide.

Null or empty text has no words and fails the base rule. Repeated rows are judged alike; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import saved, workspace
from pagewright.llm.wordscan import SPACE, Texts, gram_ids, inside, row_index, slices, span_ids, sum_by_row

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_distinct", "n_letters", "n_upper", "n_ends"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: A rule votes bad (0) on the first condition, good (1) on the second, and abstains on neither.
RULES = {
    "length": lambda: _vote(F.col("n_words") < 40, F.col("n_words") >= 120),
    "word_size": lambda: _vote(~_share("word_chars", "n_words").between(3.8, 7.0), _share("word_chars", "n_words").between(4.4, 6.0)),
    "symbols": lambda: _vote(_share("n_symbols", "word_chars") > 0.04, _share("n_symbols", "word_chars") < 0.005),
    "letters": lambda: _vote(_share("n_letters", "word_chars") < 0.88, _share("n_letters", "word_chars") > 0.93),
    "digits": lambda: _vote(_share("n_digits", "word_chars") > 0.15, _share("n_digits", "word_chars") < 0.03),
    "windows": lambda: _vote(_share("n_repeat_words", "n_words") > 0.25, _share("n_repeat_words", "n_words") < 0.05),
    "vocabulary": lambda: _vote(_share("n_distinct", "n_words") < 0.40, _share("n_distinct", "n_words") > 0.55),
    "lines": lambda: _when_enough("n_lines", 4, _share("n_dup_lines", "n_lines") > 0.20, _share("n_dup_lines", "n_lines") < 0.05),
    "sentences": lambda: _when_enough("n_words", 40, _share("n_ends", "n_words") < 0.01, _share("n_ends", "n_words").between(0.03, 0.25)),
    "capitals": lambda: _when_enough("n_letters", 100, ~_share("n_upper", "n_letters").between(0.002, 0.20), _share("n_upper", "n_letters").between(0.008, 0.10)),
}
#: Where EM starts and what it leans on where votes are few: how often a rule votes bad on bad and on good documents,
#: and how much of a corpus is good. The leaning is worth so many documents, at any size.
BAD_RATE = {"bad": 0.4, "good": 0.05}
GOOD_SHARE, PRIOR_DOCS = 0.9, 10
#: Start of the posterior by number of bad votes: one says little.
START = (0.98, 0.7, 0.1)
ROUNDS = 500
MIN_PROBABILITY = 0.5


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SYMBOL, DIGIT, ENDS = _table(b"#*$%&|<>"), _table(bytes(range(48, 58))), _table(b".!?")
UPPER = _table(bytes(range(65, 91)))
#: ASCII letters, and first bytes of all characters beyond ASCII.
LETTER = UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(0xC0, 0x100)))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def _when_enough(what: str, least: int, bad: Column, good: Column) -> Column:
    """A vote on texts with enough to judge by, else none."""
    return F.when(F.col(what) >= least, _vote(bad, good)).otherwise(-1)


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def measure(arr: pa.Array) -> dict[str, np.ndarray]:
    """The features of each text."""
    t = Texts(arr)
    starts, ends, off = t.words()
    n_words = np.diff(off)
    solid = ~SPACE[t.bytes]
    per_row = lambda flags: sum_by_row(flags.astype(np.int64), t.edges)
    ids, row = span_ids(t, starts, ends), row_index(off)
    own = lambda number, rows: number * t.n + rows  # noqa: E731  a number within its row
    first = np.unique(own(ids, row), return_index=True)[1]
    ok = inside(off, 3)
    covered = np.zeros(len(ids), bool)
    if ok.any():
        at = np.flatnonzero(ok)
        twice = at[_repeats(own(gram_ids(ids, 3)[at], row[at]))]
        for d in range(3):
            covered[twice + d] = True
    l_start, l_end, l_off = t.lines()
    has_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    keys = own(span_ids(t, l_start, l_end), row_index(l_off))[has_word]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    line_rows = row_index(l_off)[has_word]
    return {
        "n_words": n_words,
        "word_chars": per_row(solid & ((t.bytes & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOL[t.bytes]),
        "n_dup_lines": np.bincount(line_rows[again], minlength=t.n),
        "n_repeat_words": sum_by_row(covered.astype(np.int64), off),
        "n_lines": np.bincount(line_rows, minlength=t.n),
        "n_digits": per_row(DIGIT[t.bytes]),
        "n_distinct": np.bincount(row[first], minlength=t.n),
        "n_letters": per_row(LETTER[t.bytes]),
        "n_upper": per_row(UPPER[t.bytes]),
        "n_ends": per_row(ENDS[t.bytes]),
    }


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``FEATURES`` (long) of every whole text in front; columns of those names are replaced."""
    kept = docs.drop(*FEATURES)
    schema = ", ".join([*[f"{f} bigint" for f in FEATURES], *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                got = measure(part.column(text))
                yield pa.RecordBatch.from_arrays([*[pa.array(got[f].astype(np.int64)) for f in FEATURES], *part.columns], [*FEATURES, *part.schema.names])

    return kept.mapInArrow(run, schema)


def voted(features: DataFrame) -> DataFrame:
    return features.select("*", *[rule().alias(f"vote_{k}") for k, rule in RULES.items()])


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, np.ndarray]:
    """EM over counted vote patterns: prior of good, and per rule the rates of a bad vote on (bad, good) documents."""
    lean = np.array([BAD_RATE["bad"], BAD_RATE["good"]])
    rates = np.tile(lean, (n_rules, 1))
    if not patterns:
        return GOOD_SHARE, rates
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    voted, bad = v >= 0, v == 0
    q = np.array(START)[np.minimum(bad.sum(1), len(START) - 1)]
    prior = GOOD_SHARE
    for _ in range(ROUNDS):
        prior = float(((q * n).sum() + GOOD_SHARE * PRIOR_DOCS) / (n.sum() + PRIOR_DOCS))
        for side, share in enumerate((1 - q, q)):
            w = (share * n)[:, None]
            rates[:, side] = ((w * bad).sum(0) + lean[side] * PRIOR_DOCS) / ((w * voted).sum(0) + PRIOR_DOCS)
        new = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + evidence(rates, voted, bad))))
        moved, q = abs(new - q).max(), new
        if moved < 1e-9:
            break
    return prior, rates


def evidence(rates: np.ndarray, voted: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log odds of good that the votes add."""
    on_bad, on_good = np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
    return np.where(voted, np.where(bad, on_bad, on_good), 0).sum(1)


def learn(features: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """Prior and rates from the votes on all documents: at most 3 ** len(RULES) counted patterns reach the driver."""
    votes = [f"vote_{k}" for k in RULES]
    counted = [(tuple(r[v] for v in votes), r["n"]) for r in voted(features).groupBy(*votes).agg(F.count("*").alias("n")).collect()]
    prior, rates = fit(sorted(counted), len(votes))
    return prior, [(float(a), float(b)) for a, b in rates]


def scored(features: DataFrame, model: tuple[float, list[tuple[float, float]]]) -> DataFrame:
    """Adds one vote per rule, ``quality`` (posterior of good), base_failed and kept."""
    prior, rates = model
    logit = F.lit(float(np.log(prior / (1 - prior))))
    for k, (on_bad, on_good) in zip(RULES, rates, strict=True):
        v = F.col(f"vote_{k}")
        logit = logit + F.when(v == 0, float(np.log(on_good / on_bad))).when(v == 1, float(np.log((1 - on_good) / (1 - on_bad)))).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return voted(features).withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= MIN_PROBABILITY))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, features, votes, quality, base_failed, kept. Features are measured once and written."""
    features = saved(with_features(docs.select(F.col("doc_id").cast("long"), "text")).drop("text"))
    return scored(features, learn(features))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; texts are measured twice and never move."""
    with workspace(docs.sparkSession):
        model = learn(saved(with_features(docs.select("text")).drop("text")))
    own = docs.toDF(*[f"_{c}" for c in docs.columns])  # no column of the rows meets a feature's name
    return scored(with_features(own, "_text"), model).where("kept").select(*[F.col(f"`_{c}`").alias(c) for c in docs.columns])


def quality_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", *FEATURES[:5], "base_failed", "kept", F.round("quality", 9).alias("quality"))
