"""Question mining over lines of text: heads, statements, code, options, and the rebuilt text.

Windows and groupings are keyed by ``image_id`` (and the question number in it), over ``line_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import values as V
from pagewright.functions.rules import Rule, apply_global_fixes
from pagewright.functions.text import clean_option_text, is_code_line, is_option_line, is_question_head, n_words, normalize_option_line, once, strip

RULE = "─" * V.RULE_WIDTH
STRINGS = "array<string>"


def text_lines(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """image_id, line_no, line of each page's text, and the columns in ``carry``."""
    return docs.select("image_id", *carry, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def mark_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``s`` (stripped), ``is_head`` and ``is_option``."""
    return lines.withColumn("s", strip(F.col("line"))).withColumn("is_head", is_question_head(F.col("s"))).withColumn("is_option", is_option_line(F.col("s")))


def classify_documents(lines: DataFrame) -> DataFrame:
    """Per page: counts and the route: plain text, options without heads, or exam."""
    counted = mark_lines(lines).groupBy("image_id").agg(F.count_if("is_head").alias("n_heads"), F.count_if("is_option").alias("n_options"))
    return counted.withColumn("route", route(F.col("n_heads"), F.col("n_options")))


def route(heads: Column, options: Column) -> Column:
    return F.when((heads < 2) & (options < 4), "plain").when(heads == 0, "options").otherwise("exam")


def segment_questions(lines: DataFrame) -> DataFrame:
    """Lines with ``q_no``: 0 before the first head, then the question each belongs to. Lines as from ``mark_lines``."""
    return lines.withColumn("q_no", F.sum(F.col("is_head").cast("int")).over(Window.partitionBy("image_id").orderBy("line_no")))


def terminated(s: Column) -> Column:
    return s.rlike("[:.?]$")


def starts_small(s: Column) -> Column:
    return s.rlike(r"^\p{javaLowerCase}")


def statement_ends(body: DataFrame) -> DataFrame:
    """Body lines of questions (without outer blanks) with ``stop`` and ``rest_start``, the index after the statement.

    Whether a line ends the statement depends on it, the last non-blank line before and the next one after it.
    """
    question = Window.partitionBy("image_id", "q_no")
    order = question.orderBy("j")
    filled = F.when(F.col("s") != "", F.col("s"))
    after = F.first(filled, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(filled, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    blank = F.col("s") == ""
    wraps = (~terminated(F.col("before"))) & (n_words(F.col("after")) >= 2)
    blank_stop = ~F.coalesce(starts_small(F.col("after")) | wraps, F.lit(False))
    short = ~starts_small(F.col("after")) & (n_words(F.col("after")) < 2) & (F.length("after") < F.length("s") * 0.4)
    stop = F.when(blank, blank_stop).otherwise(terminated(F.col("s")) | F.col("after").isNull() | F.coalesce(short, F.lit(False)))
    marked = body.withColumn("after", after).withColumn("before", before).withColumn("stop", stop)
    first = F.min(F.when(F.col("stop"), F.col("j"))).over(question)
    return marked.withColumn("rest_start", F.coalesce(first + 1, F.max("j").over(question) + 1)).drop("after", "before")


def question_bodies(segmented: DataFrame) -> DataFrame:
    """Lines after each head, without outer blank ones, numbered ``j`` from 0."""
    body = segmented.where((F.col("q_no") > 0) & ~F.col("is_head"))
    question = Window.partitionBy("image_id", "q_no")
    filled = F.when(F.col("s") != "", F.col("line_no"))
    inner = body.withColumn("lo", F.min(filled).over(question)).withColumn("hi", F.max(filled).over(question)).where(F.col("line_no").between(F.col("lo"), F.col("hi")))
    return inner.withColumn("j", F.col("line_no") - F.col("lo")).drop("lo", "hi")


def with_parts(ends: DataFrame) -> DataFrame:
    """Body lines with ``part``: statement, code or option; null for blank lines."""
    question = Window.partitionBy("image_id", "q_no")
    filled = F.col("s") != ""
    rest = filled & (F.col("j") >= F.col("rest_start"))
    code = is_code_line(F.col("s"))
    lines = ends.withColumn("first_text", F.min(F.when(rest & ~code, F.col("j"))).over(question))
    option = rest & F.col("first_text").isNotNull() & (F.col("j") >= F.col("first_text"))
    lines = lines.withColumn("part", F.when(~filled, None).when(~rest, "statement").when(option, "option").otherwise("code"))
    # Without any option, the last three of three or more code lines are the options.
    n_code = F.count_if(F.col("part") == "code").over(question)
    n_option = F.count_if(F.col("part") == "option").over(question)
    last = F.sum(filled.cast("int")).over(question.orderBy(F.desc("j")))
    lines = lines.withColumn("n_code", n_code).withColumn("n_option", n_option).withColumn("last", last)
    hidden = (F.col("part") == "code") & (F.col("n_option") == 0) & (F.col("n_code") >= 3) & (F.col("last") <= 3)
    return lines.withColumn("part", F.when(hidden, "option").otherwise(F.col("part"))).drop("n_code", "n_option", "last", "first_text")


def split_code_options(ends: DataFrame) -> DataFrame:
    """Non-blank body lines with ``part``: statement, code or option."""
    return with_parts(ends).where("part is not null")


def all_parts(marked: DataFrame, *carried: str) -> DataFrame:
    """All lines of ``segment_questions``, with the columns ``carried`` and ``part``: preamble, head, statement, code or option, null for blank lines
    in and around bodies. One pass: bodies keep apart from other lines by the sign of their question's number."""
    question = Window.partitionBy("image_id", "q_no")
    below = (F.col("q_no") > 0) & ~F.col("is_head")
    filled = F.when(below & (F.col("s") != ""), F.col("line_no"))
    placed = marked.withColumn("lo", F.min(filled).over(question)).withColumn("hi", F.max(filled).over(question))
    inner = F.coalesce(below & F.col("line_no").between(F.col("lo"), F.col("hi")), F.lit(False))
    body = placed.withColumn("inner", inner).withColumn("q_no", F.when(F.col("inner"), F.col("q_no")).otherwise(-F.col("q_no") - 1))
    parts = with_parts(statement_ends(body.withColumn("j", F.col("line_no") - F.coalesce("lo", F.lit(0)))))
    number = F.when(F.col("inner"), F.col("q_no")).otherwise(-F.col("q_no") - 1)
    part = F.when(F.col("inner"), F.col("part")).when(F.col("is_head"), "head").when(number == 0, "preamble")
    return parts.select("image_id", number.alias("q_no"), "line_no", "line", "s", part.alias("part"), *carried)


def gathered(parts: DataFrame, *carried: Column) -> DataFrame:
    """image_id, q_no, preamble, header, statement, code, options: the lines of each question, and of what precedes the first."""

    def lines_of(part: str, value: Column) -> Column:
        held = F.collect_list(F.when(F.col("part") == part, F.struct("line_no", value.alias("v"))))
        return F.transform(F.array_sort(held), lambda x: x["v"])

    return parts.groupBy("image_id", "q_no").agg(
        lines_of("preamble", F.col("line")).alias("preamble"),
        F.max(F.when(F.col("part") == "head", F.col("s"))).alias("header"),
        lines_of("statement", F.col("line")).alias("statement"),
        lines_of("code", F.col("line")).alias("code"),
        lines_of("option", F.col("s")).alias("options"),
        *carried,
    )


def extract_questions(lines: DataFrame) -> DataFrame:
    """image_id, q_no, header, statement, code, options of every question in lines of text."""
    return gathered(all_parts(segment_questions(mark_lines(lines)))).where("q_no > 0").drop("preamble")


def exam_text(blocks: Column) -> Column:
    """Preamble, then each question under a rule, options marked. ``blocks``: array of ``gathered`` structs in order."""
    none, blank = F.array().cast(STRINGS), F.array(F.lit(""))

    def lines(b: Column) -> Column:
        options = F.transform(F.filter(F.transform(b["options"], clean_option_text), lambda o: o != ""), lambda o: F.concat(F.lit(f"{V.RADIO} "), o))
        code = F.when(F.size(b["code"]) > 0, F.concat(blank, b["code"], blank)).otherwise(none)
        return F.when(b["header"].isNull(), b["preamble"]).otherwise(F.concat(F.array(F.lit(RULE), F.lit("")), F.array(b["header"]), b["statement"], code, options))

    def joined(parts: Column) -> Column:
        # A blank line goes before a rule only if something not blank precedes it.
        gap = F.transform(parts, lambda b, i: F.when((i > 0) & (strip(F.element_at(parts[F.greatest(i - 1, F.lit(0))], -1)) != ""), F.concat(blank, b)).otherwise(b))
        return F.array_join(F.flatten(gap), "\n")

    return once(F.transform(blocks, lines), joined)


def in_order(*columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("q_no", *columns)))


PARTS = ["preamble", "header", "statement", "code", "options"]


def rebuild_exam_text(lines: DataFrame, questions: DataFrame) -> DataFrame:
    """Per page with questions: preamble, then each question under a rule, options marked; before global fixes."""
    none = F.array().cast(STRINGS)
    first = segment_questions(mark_lines(lines)).where("q_no = 0").groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("preamble"))
    first = first.select("image_id", F.lit(0).cast("long").alias("q_no"), "preamble", F.lit(None).cast("string").alias("header"), *[none.alias(c) for c in PARTS[2:]])
    every = questions.withColumn("preamble", none).select("image_id", "q_no", *PARTS).unionByName(first)
    pages = every.groupBy("image_id").agg(in_order(*PARTS).alias("blocks"), F.max("q_no").alias("last"))
    return pages.where("last > 0").select("image_id", exam_text(F.col("blocks")).alias("text"))


def post_process_documents(docs: DataFrame, carry: tuple[str, ...] = (), rules: list[Rule] | None = None) -> DataFrame:
    """image_id, route and text after the route's repairs, and the columns in ``carry``. ``docs``: image_id, text;
    ``rules``: those of whole texts, unless given the library's.

    One exchange on the page, none if the pages are dealt by it: lines are marked, routed, cut into questions and put
    together again where they lie. Pages of other routes have no heads, so all their lines are preamble.
    """
    page = Window.partitionBy("image_id")
    lines = mark_lines(text_lines(docs, carry=carry))
    routed = lines.withColumn("route", route(F.count_if("is_head").over(page), F.count_if("is_option").over(page)))
    routed = routed.withColumn("is_head", F.col("is_head") & (F.col("route") == "exam"))
    options = F.when(F.col("route") == "options", normalize_option_line(F.col("line"))).otherwise(F.col("line"))
    segmented = segment_questions(routed.withColumn("line", options))
    kept = ["route", *carry]
    blocks = gathered(all_parts(segmented, *kept), *[F.max(c).alias(c) for c in kept])
    pages = blocks.groupBy("image_id").agg(*[F.max(c).alias(c) for c in kept], in_order(*PARTS).alias("blocks"))
    whole = pages.select("image_id", *kept, apply_global_fixes(exam_text(F.col("blocks")), rules).alias("text"))
    return whole.withColumn("text", F.when(F.col("route") == "exam", F.regexp_replace("text", "\n{4,}", "\n\n\n")).otherwise(F.col("text")))
