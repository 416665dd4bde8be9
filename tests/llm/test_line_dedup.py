"""Line dedup against plain Python, and its SQL."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pagewright.llm import line_dedup as ld

UP = str.maketrans(ld.UPPER, ld.LOWER)
SCHEMA = "doc_id long, text string"


def brute(rows, chars=40, docs=5):
    """(id, text) rows without null or repeated ids."""
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda x: x.strip(ld.BLANKS).translate(UP)
    holders = defaultdict(set)
    for i, lines in split.items():
        for x in lines:
            if len(key(x)) >= chars:
                holders[key(x)].add(i)
    out = {}
    for i, lines in split.items():
        gone = [len(holders[key(x)]) >= docs and max(holders[key(x)]) != i if len(key(x)) >= chars else False for x in lines]
        text = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out[i] = (len(lines), sum(gone), hashlib.sha256(text.encode()).hexdigest())
    return out


def run(spark, rows):
    got = ld.lines_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got}


def made(seed):
    rng = random.Random(seed)
    common = [f"Line {k} é ".ljust(rng.choice([38, 39, 40, 41, 90]), rng.choice("xY")) for k in range(12)]
    deco = lambda x: rng.choice(["", " ", "\t\r", " "]) + rng.choice([x, x.upper(), x.lower()]) + rng.choice(["", "\x0b \x0c"])
    rows = []
    for d in range(60):
        lines = [deco(rng.choice(common[: rng.choice([3, 12])])) if rng.random() < 0.6 else f"own {d} {rng.random()}" * rng.randint(0, 3) for _ in range(rng.randint(0, 9))]
        rows.append((d * 3 - 20, "\n".join(lines)))
    wall = "\n".join([common[4].ljust(45, "z"), ""] * 3)
    return [*rows, (500, None), (501, ""), (502, "\n"), (503, "\n\n"), *[(600 + k, wall) for k in range(5)], (700, common[0].ljust(60, "q") * 4000), (701, (common[0].ljust(60, "q") + "\n") * 3000)]


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert run(spark, rows) == brute(rows)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ld, "is_small", lambda df: False)
    monkeypatch.setattr(ld, "OFTEN", 8)
    rows = made(3)
    assert run(spark, rows) == brute(rows)


def test_few_lines_make_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the keys and positions of few lines are one file each."""
    files = []

    def save(df, write=ld.saved, **how):
        out = write(df, **how)
        files.append((out.columns[0], len(out.inputFiles())))
        return out

    monkeypatch.setattr(ld, "saved", save)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = made(4)
        assert run(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files[1:] == [("k1", 1), ("id", 1)]


def test_rows_with_one_id_and_without_any(spark):
    line, other = "a line that is long enough to be judged here", "another line that is long enough to be judged"
    # Five rows of one id are one document; with four further ids the line is shared, and the largest keeps it.
    rows = [(1, line + "\nx")] * 5 + [(2, line), (3, line)]
    assert {d for _, d, _ in run_list(spark, rows)} == {0}
    rows += [(1, "y\n" + line), (4, line), (9, line), (9, line)]
    assert sorted((i, d) for i, d, _ in run_list(spark, rows)) == [(1, 1)] * 6 + [(2, 1), (3, 1), (4, 1), (9, 0), (9, 0)]
    # Without ids, texts are documents; one with an id keeps before them.
    rows = [(None, f"{other}\n{k}") for k in range(5)]
    got = run_list(spark, rows)
    assert sorted(d for _, d, _ in got) == [0, 1, 1, 1, 1]
    got = run_list(spark, [*rows, (-7, other)])
    assert sorted((i is None, d) for i, d, _ in got) == [(False, 0)] + [(True, 1)] * 5


def run_list(spark, rows):
    return [(r.doc_id, r.n_dropped, r.kept_sha256) for r in ld.lines_digest(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_other_columns_and_empty_tables(spark):
    line = "a line that is long enough to be judged here"
    df = spark.createDataFrame([(k, f"{k}\n{line}", "own", k, 1, 2) for k in range(6)], "doc_id int, text string, line string, at long, _own int, n_lines int")
    got = ld.drop_shared_lines(df).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["0", "1", "2", "3", "4", f"5\n{line}"] and [r["at"] for r in got] == list(range(6)) and got[0].line == "own" and got[0].n_lines == 2
    assert ld.lines_digest(df.limit(0)).collect() == []
    assert ld.drop_shared_lines(df, least_docs=7).where("n_dropped > 0").count() == 0


def test_no_python_in_the_plan(spark):
    plan = ld.lines_digest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("line", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
