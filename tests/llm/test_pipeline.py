"""Each stage of the pipeline against the brute-force versions of its operator."""

import corpus_pipeline as cp
from pagewright.llm.common import drop_saved
from pagewright.llm.weak_quality import judge
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_near_dup import brute as brute_classes
from tests.llm.test_spans import brute_secrets

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:-1]:
        out = cp.saved(stage(spark, docs, DATA))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            want = {r.doc_id for r in judge(docs).where("kept").collect()}
            assert 0 < len(want) < len(rows)
        elif name == "near_duplicates":
            want = {i for i, c in brute_classes([(i, r.text) for i, r in rows.items()]).items() if i == c}
        elif name == "decontamination":
            want = {i for i, v in brute_contamination([(i, r.text) for i, r in rows.items()], bench).items() if not v[4]}
        else:
            want = set(rows)
            for i, r in got.items():
                assert sum(brute_secrets(r.text)[0]) == 0 and r.n_chars == len(r.text)
                assert r == rows[i] or "[SECRET]" in r.text
            assert any("[SECRET]" in r.text for r in got.values())
        assert set(got) == want
        if name != "secrets":
            assert all(got[i] == rows[i] for i in got)
        docs, rows = out, got
    packed = cp.packing(spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert cp.run(spark, DATA).count() == len(packed)


def test_repeated_rows_and_clashing_columns(spark):
    text = " ".join(a + b + "word" for a in "abcdefghij" for b in "klmnopqrs")
    df = spark.createDataFrame([(1, text, "en", "s", 9, 0.5), (1, text, "en", "s", 9, 0.5), (2, text, "en", "s", 9, 0.5), (3, None, "en", "s", 0, 0.5)], "doc_id long, text string, lang string, source string, n_chars long, quality double")
    assert [r.doc_id for r in cp.near_duplicates(spark, df, DATA).orderBy("doc_id").collect()] == [1, 3]
    assert sorted(r.doc_id for r in cp.quality(spark, df, DATA).collect()) == [1, 1, 2]
    assert {(r.quality, r.text) for r in cp.quality(spark, df, DATA).collect()} == {(0.5, text)}


def test_saved_tables_can_be_dropped(spark):
    kept = cp.saved(spark.range(5))
    assert kept.count() == 5
    assert drop_saved(spark) >= 1 and drop_saved(spark) == 0
