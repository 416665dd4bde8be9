"""Every registered query of the library against its SQL, and plans against the shuffles they should have."""

import glob
import os
import re
from decimal import Decimal

import duckdb
import pytest

from pagewright import fixtures
from pagewright.operators import candidates, exam, layout
from pagewright.operators.words import filter_words, mark_radio
from pagewright.plans import workflows
from pagewright.plans.workflows import lay_out, recognised_documents
from pagewright.queries import ORACLES, QUERIES
from pagewright.sources import io
from pagewright import tables
from pagewright.tables import bucketed
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = con.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in result.fetchall())
    assert got == want and got


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_one_exchange_from_words_to_text(spark):
    words = mark_radio(filter_words(spark.range(10).selectExpr("id image_id", "2800 image_width", "400 image_height", "id ord", "'a' text", "50D conf", "1 left", "1 top", "9 width", "9 height", "1 block_num", "1 par_num", "1 line_num"), 8.0)).repartition("image_id")
    lines = layout.build_lines(words)
    assert exchanges(lines) == 1
    assert exchanges(layout.reading_order(layout.detect_columns(layout.build_blocks(lines)))) == 1
    assert "Python" not in words._jdf.queryExecution().executedPlan().toString()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_workload_moves_little(spark):
    """Lines are written in buckets from one exchange of the winners' words; documents and their repair take none more,
    and no second read of the words."""
    words = fixtures.ocr_words(spark, DATA)
    pages = lay_out(words, 8.0)
    assert exchanges(pages.docs) == 0 and plan_of(pages.docs).count("FileScan parquet") == 1
    assert exchanges(pages.blocks) == 0 and exchanges(pages.columns) <= 1
    assert "Join" not in plan_of(pages.docs)
    rows = spark.createDataFrame([(1, "Pregunta 1\nuno"), (2, "x")], "image_id long, text string")
    assert exchanges(exam.post_process_documents(rows)) == 1


def moved(df) -> list[str]:
    """What lies below the exchanges of a plan: the nodes that read tables."""
    out = []

    def walk(node, below: bool):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.inputPlan(), below)
        kids = node.children()
        if below and kids.size() == 0:
            out.append(node.toString())
        below = below or name in ("Exchange", "BroadcastExchange")
        for i in range(kids.size()):
            walk(kids.apply(i), below)

    walk(df._jdf.queryExecution().executedPlan(), False)
    return out


def test_words_in_buckets_are_never_dealt_again(spark, monkeypatch):
    """From candidates in buckets through scores, winners, layout, repair and exports no word and no line moves, however
    large the tables are: nothing is broadcast here."""
    monkeypatch.setattr(candidates, "is_small", lambda df: False)
    monkeypatch.setattr("pagewright.plans.workflows.small_side", lambda df, *a, **b: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = bucketed(fixtures.candidate_words(spark, DATA), "image_id")
        ids = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("image_id"))
        rank = bucketed(ids.withColumn("psm_order", F.array(F.lit(3), F.lit(6))), "image_id")
        quality = ids.withColumn("suggested_confidence", F.lit(8.0))
        kept = filter_words(words)
        scores = candidates.score_candidates(kept)
        assert moved(scores) == [] and "ObjectHashAggregate" not in plan_of(scores) and "SortAggregate" not in plan_of(scores)
        assert moved(candidates.winners(kept, rank)) == []
        assert not any("bucketed_" in x for x in moved(candidates.keep_winner_words(kept, rank)))
        p = recognised_documents(words, quality, rank, pages=ids, dealt=True)
        for df in (p.blocks, p.docs, p.account):
            assert not any("bucketed_" in x for x in moved(df))
        p = recognised_documents(words, quality, rank, dealt=True)
        assert moved(p.blocks) == moved(p.docs) == [] and len(moved(p.columns)) <= 1
        for df in (io.json_struct(p.docs, p.placed, True), io.export_paragraphs(p.docs, p.placed), layout.document_stats(p.placed, p.docs), io.docx_content(p.docs, p.placed)):
            assert moved(df) == []
        assert p.docs.count() > 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_winners_by_join_equal_winners_by_broadcast(spark, monkeypatch):
    words = filter_words(bucketed(fixtures.candidate_words(spark, DATA), "image_id"), 8.0)
    rank = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.array(F.lit(3), F.lit(6)).alias("psm_order"))
    a = candidates.keep_winner_words(words, rank)
    monkeypatch.setattr(candidates, "is_small", lambda df: False)
    b = candidates.keep_winner_words(words, rank)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_medians_without_sorting_words(spark):
    rows = [(1, 0, 3, t, c) for t, c in [("ab", 10.0), ("cd", 20.0), ("ef", 30.0), ("gh", 40.0), ("!", 99.0)]]
    rows += [(2, 0, 3, "ab", 7.5), (3, 1, 6, "!", 50.0), (4, 0, 3, "ab", None), (5, 0, 3, "ab", 5.0), (5, 0, 3, "ab", 5.0), (5, 0, 3, "cd", 9.0), (None, None, None, "ab", 3.0)]
    got = {r.image_id: (r.real_words, r.score, r.word_count, r.avg_confidence) for r in candidates.score_candidates(spark.createDataFrame(rows, "image_id long, variant int, psm int, text string, conf double")).collect()}
    assert got == {1: (4, 120.0, 5, 39.8), 2: (1, 7.5, 1, 7.5), 3: (0, 0.0, 1, 50.0), 4: (0, 0.0, 1, None), 5: (3, 15.0, 3, 19 / 3), None: (1, 3.0, 1, 3.0)}


def test_every_page_is_accounted_for(spark):
    account = QUERIES["a1_page_account"](spark, DATA).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert len(account) == len(ids) and {r.image_id for r in account} == ids
    assert {r.outcome for r in account} == {"exported", "no_quality", "all_failed", "empty"}
    assert all((r.outcome == "exported") == (r.word_count > 0) for r in account)


def test_placed_lines_equal_the_single_steps(spark):
    lines = layout.format_lines(layout.build_lines(mark_radio(filter_words(fixtures.ocr_words(spark, DATA), 8.0))))
    blocks = layout.reading_order(layout.detect_columns(layout.build_blocks(lines)))
    got = layout.blocks_of(layout.place_lines(lines)).select(*blocks.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, blocks.collect()))
    docs = layout.documents_of(layout.place_lines(lines)).select("image_id", "column_count", "n_blocks", "formatted_text")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, layout.format_text(lines, blocks).select(*docs.columns).collect()))


def test_images_are_decoded_once(spark):
    tasks = QUERIES["workload_b_tasks"](spark, DATA)
    assert "MapInPandas" not in plan_of(tasks)  # features were written


def test_results_do_not_depend_on_partitions(spark):
    words = fixtures.ocr_words(spark, DATA)

    def text(df):
        lines = layout.build_lines(mark_radio(filter_words(df, 8.0)))
        blocks = layout.reading_order(layout.detect_columns(layout.build_blocks(lines)))
        return {r.image_id: r.formatted_text for r in layout.format_text(layout.format_lines(lines), blocks).collect()}

    assert text(words) == text(words.orderBy(F.rand(3)).repartition(5))


def test_reading_order_permutes_blocks(spark):
    lines = layout.build_lines(filter_words(fixtures.ocr_words(spark, DATA), 8.0))
    blocks = layout.reading_order(layout.detect_columns(layout.build_blocks(lines)))
    bad = blocks.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("read_ord")).alias("o")).where(F.col("o") != F.sequence(F.lit(1), F.col("n").cast("int")))
    assert bad.count() == 0


def test_failed_candidates_are_skipped(spark):
    empty = spark.createDataFrame([], "image_id long, variant int, psm int, text string, conf double")
    assert candidates.score_candidates(empty).count() == 0


def test_derived_lines_hold_all_lines(spark):
    """Every given line is part of a derived one; literals that stand alone are lines besides."""
    lines0 = spark.sql(fixtures.SPARK_LINES, documents=spark.read.parquet(f"{DATA}/documents.parquet"))
    for derived, alone in ((fixtures.dirty_lines, r"^(\|\||ab|○|O rden)$"), (fixtures.exam_lines, r"^(Pregunta \d+|x = \d+|print\(x\)|)$")):
        got: dict = {}
        for r in derived(spark, DATA).collect():
            got.setdefault(r.image_id, []).append((r.line_no, r.line))
        for r in lines0.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("given")).collect():
            lines = iter([x for _, x in sorted(got[r.doc_id])])
            for _, given in r.given:  # in order, with nothing but literals between them
                x = next(lines)
                while given not in x or (re.match(alone, x) and x != given):
                    assert re.match(alone, x)
                    x = next(lines)


def test_words_are_derived_where_their_documents_lie(spark):
    """As the windows of the SQL give them, in lines of any length; only documents move."""
    texts = ["", " ", "a", "a  b \n\n c", " ".join(f"w{i % 13 * 'x'}é" for i in range(2500)), "\n".join(" ".join("ab" * (i % 5) for i in range(n)) for n in (31, 32, 33, 64, 65, 1023, 1024, 1025)), None]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = "SELECT doc_id, line_no, CAST(word_no AS BIGINT) AS word_no, word FROM lines0 LATERAL VIEW posexplode(split(line, ' ')) b AS word_no, word"
    windows = [f"{w} AS {c}" for w, c in fixtures.IN_PLACE.items()]
    want = spark.sql(f"WITH lines0 AS ({fixtures.SPARK_LINES}), tokens AS ({plain}) SELECT *, {', '.join(windows)} FROM tokens", documents=documents)
    key = lambda r: (r.doc_id, r.line_no, r.word_no, r.word, r.n_lines, r.at)
    got = sorted(map(key, fixtures.tokens(documents).collect()))
    assert got == sorted(map(key, want.collect())) and len(got) > 5000
    assert moved(fixtures.tokens(documents)) == []


@pytest.mark.parametrize("name", ["c2_score_candidates", "c3_select_best", "s2_read_ocr_words", "l1_build_lines", "l6_reading_order"])
def test_only_documents_move_to_queries_of_words(spark, name):
    df = QUERIES[name](spark, DATA)
    assert exchanges(df) <= 1 and all("FileScan parquet" in x and "doc_id" in x for x in moved(df) if "OneRow" not in x)


def test_scores_are_derived_once_for_pending_tasks(spark):
    assert "posexplode(split(piece" not in plan_of(QUERIES["c4_pending_tasks"](spark, DATA))


def test_no_page_is_laid_out_for_the_account(spark, monkeypatch):
    """Nor are words sorted or dealt, whatever does not fit into a broadcast."""
    monkeypatch.setattr(candidates, "is_small", lambda df: False)
    monkeypatch.setattr(workflows, "is_small", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = [p for p in tables._loose if "bucketed_" in p]
    try:
        for name in ("a1_page_account", "a2_page_rejects"):
            QUERIES[name](spark, DATA).count()
        assert [p for p in tables._loose if "bucketed_" in p] == before
        words = fixtures.candidate_words(spark, DATA)
        ids = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("image_id"))
        plan = plan_of(workflows.words_above(ids.withColumn("suggested_confidence", F.lit(8.0)))(words))
        assert "ShuffledHashJoin" in plan and "Sort " not in plan and exchanges(words) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_without_words(spark):
    """Documents and paragraphs are the same; what is written holds no word twice and no line twice."""
    words = fixtures.ocr_words(spark, DATA)
    a, b = (lay_out(words, 8.0, post_process=False, dealt=True, keep_words=k) for k in (True, False))
    assert "words" in a.placed.columns and "words" not in b.placed.columns and b.lines.columns == [c for c in a.lines.columns if c != "words"]
    assert sorted(map(tuple, a.docs.collect())) == sorted(map(tuple, b.docs.collect()))
    assert "formatted" not in spark.read.parquet(a.placed.inputFiles()[0]).columns
    for name in ("s3_txt_content", "s7_export_paragraphs", "l8_format_text"):
        scans = re.findall(r"ReadSchema: (.*)", QUERIES[name](spark, DATA)._jdf.queryExecution().toString())
        assert scans and not any(re.search(r"\bwords\b", x) for x in scans)
