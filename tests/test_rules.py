"""Rules as data: the lists against the single steps, triggers, tables of rules."""

import pytest
from pyspark.sql import functions as F

from pagewright import fixtures
from pagewright.functions import rules as R
from pagewright.functions import text as T

DATA = "/root/testdata/sf0.001"
LINE_STEPS = [T.fix_chars, T.fix_inverted_bang, T.split_underscores, T.split_radio_prefix, T.fix_empty_brackets, T.fix_checked, T.drop_symbol_noise, T.collapse_spaces]
TEXT_STEPS = [T.fix_code_tokens, T.fix_gender, T.split_glued_words, T.fix_accents, T.fix_digit_letters, T.shorten_runs, T.drop_noise_lines]
ODD = ["", " ", "\u00a0\u00a0 x\u00a0\u00a0\u00a0y", "a\u00a0 \u00a0b", "\u3000Oz\u3000", "[ ]", "[x]", "\ufb01n", "\u06611l\u0662", "1l1l1O0", "..........", "esuna esun", "Ist Ien", "x \u00a9 \u00ae y", "\u00a1+", "=\u00a1+1", "   ", "____a"]


def both(spark, steps, f):
    lines = fixtures.dirty_lines(spark, DATA).select("line").unionByName(spark.createDataFrame([(x,) for x in ODD] + [(None,)], "line string"))
    value = F.col("line")
    chained = lines
    for k, step in enumerate(steps):
        chained = chained.select("line", step(value).alias(f"s{k}"))
        value = F.col(f"s{k}")
    return chained.select("line", value.alias("want")).withColumn("got", f(F.col("line"))).where(~F.col("want").eqNullSafe(F.col("got")))


def test_lists_equal_the_single_steps(spark):
    assert both(spark, LINE_STEPS, R.fix_ocr_text).limit(3).collect() == []
    assert both(spark, TEXT_STEPS, R.apply_global_fixes).limit(3).collect() == []


def test_rules_of_a_table(spark):
    rules = [R.Rule("b", "c", R.LITERAL, ("b",)), R.Rule(r"(c+)", "<$1>", triggers=("c",)), R.Rule("split_radio_prefix", kind=R.STEP), R.Rule("x", "y", only_if="^x")]
    table = spark.createDataFrame(R.rule_rows(rules), R.RULE_TABLE)
    assert R.rules_of(table.orderBy(F.desc("ord"))) == rules
    df = spark.createDataFrame([("abc",), ("Or",), ("xx",), ("axx",), (None,), ("",)], "t string")
    got = [r.g for r in df.select(R.fix_ocr_text(F.col("t"), R.rules_of(table)).alias("g")).collect()]
    assert got == ["a<cc>", "\u25cb r", "yy", "axx", None, ""]
    assert [r.g for r in df.select(R.apply(F.col("t"), []).alias("g")).collect()] == [r.t for r in df.collect()]
    with pytest.raises(ValueError):
        R.Rule("no such step", kind=R.STEP)
    with pytest.raises(ValueError):
        R.rules_of(spark.range(R.MOST_RULES + 1).selectExpr("CAST(id AS int) AS ord", "'literal' AS kind", "'a' AS pattern", "'b' AS replacement", "array('a') AS triggers", "CAST(NULL AS string) AS only_if"))


def test_one_look_passes_texts_without_triggers():
    pattern = R.any_trigger(R.LINE_RULES)
    assert pattern.startswith("[") and "_" in pattern and "\\(\\)" in pattern
    assert R.any_trigger([R.Rule("a", "b", R.LITERAL, ("[", "^", "a-b"))]) == "[\\[\\^]|a\\-b"
