"""Words to lines, blocks, columns, reading order and text.

Every grouping and window key holds ``image_id``: after one exchange on it none of these steps shuffles again.
Ties follow ``ord``, the words' order in the recogniser's table, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import values as V
from pagewright.functions.rules import Rule, fix_ocr_text
from pagewright.functions.text import once
from pagewright.operators.words import is_header

COLUMN_GAP, LINE_GAP, WIDE_GAP = 0.15, 1.8, 3.0
MAX_INDENT, TEXT_COLUMNS, LEAST_INDENT_PX = 20, 80, 15


def join_words(words: Column) -> Column:
    """Text of a line's words, sorted left to right: three spaces where a gap is over three times the usual one."""

    def text(x: Column) -> Column:
        pieces = F.transform(words, lambda w, i: F.concat(F.when(i == 0, "").when(F.get(x["gaps"], i - 1) / x["usual"] > WIDE_GAP, "   ").otherwise(" "), w["text"]))
        return F.array_join(pieces, "")

    def with_usual(gaps: Column) -> Column:
        middle = F.element_at(F.array_sort(gaps), F.floor(F.size(gaps) / 2).cast("int") + 1)
        return F.struct(gaps.alias("gaps"), F.greatest(middle, F.lit(1)).alias("usual"))

    gaps = F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.get(words, i)["left"] - (F.get(words, i - 1)["left"] + F.get(words, i - 1)["width"])),
    ).otherwise(F.array(F.lit(1)))
    return once(once(gaps, with_usual), text)


def build_lines(words: DataFrame) -> DataFrame:
    """One row per (page, block, line) with its box, words and text; ``line_ord`` counts down the block."""
    box = words.groupBy("image_id", "block_num", (F.col("par_num") * 1000 + F.col("line_num")).alias("line_key")).agg(
        F.min("left").alias("x"),
        F.min("top").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        F.max("image_width").alias("image_width"),
        F.max("image_height").alias("image_height"),
        *[F.max("language").alias("language")] * ("language" in words.columns),
        F.array_sort(F.collect_list(F.struct("left", "ord", "text", "conf", "top", "width", "height"))).alias("words"),
    )
    order = Window.partitionBy("image_id", "block_num").orderBy("y", "line_key")
    return box.withColumn("n_words", F.size("words")).withColumn("text", join_words(F.col("words"))).withColumn("line_ord", F.row_number().over(order))


def repair_lines(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    return lines.withColumn("text", fix_ocr_text(F.col("text"), rules))


def build_blocks(lines: DataFrame) -> DataFrame:
    """One row per block; ``block_ord`` follows top, left, number."""
    blocks = lines.groupBy("image_id", "block_num").agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
        F.max("image_width").alias("image_width"),
        F.count("*").alias("n_lines"),
        F.sum("n_words").alias("n_words"),
    )
    return blocks.withColumn("block_ord", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "block_num")))


def raw_text(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: lines by line feeds, blocks set apart by an empty line."""
    placed = lines.join(blocks.select("image_id", "block_num", "block_ord"), ["image_id", "block_num"])
    sep = F.when(F.col("line_ord") > 1, "\n").when(F.col("block_ord") > 1, "\n\n").otherwise("")
    return placed.groupBy("image_id").agg(ordered_text(["block_ord", "line_ord"], F.concat(sep, "text")).alias("raw_text"))


def ordered_text(keys: list[str], piece: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, piece.alias("piece")))), lambda x: x["piece"]), "")


def detect_columns(blocks: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Blocks with ``column_id``: a new column where centres step by more than a share of the width."""
    order = Window.partitionBy("image_id").orderBy("cx", "block_ord")
    step = F.col("cx") - F.lag("cx").over(order)
    return (
        blocks.withColumn("cx", F.col("x") + F.floor(F.col("width") / 2))
        .withColumn("new", F.when(step > F.floor(F.col("image_width") * gap), 1).otherwise(0))
        .withColumn("column_id", F.sum("new").over(order))
        .drop("new")
    )


def columns_of(blocks: DataFrame) -> DataFrame:
    """One row per column with its range and its blocks from left to right."""
    return blocks.groupBy("image_id", "column_id").agg(
        F.min("x").alias("x_start"),
        F.max(F.col("x") + F.col("width")).alias("x_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("cx", "block_ord", "block_num"))), lambda b: b["block_num"]).alias("block_ids"),
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with ``read_ord``: columns left to right, each from top to bottom."""
    return blocks.withColumn("read_ord", F.row_number().over(Window.partitionBy("image_id").orderBy("column_id", "y", "cx", "block_ord")))


def indent_of(px: Column, image_width: Column) -> Column:
    return F.when((px < LEAST_INDENT_PX) | (image_width == 0), 0).otherwise(F.least(F.lit(MAX_INDENT), F.floor(px / image_width * TEXT_COLUMNS).cast("int")))


def format_lines(lines: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """Lines with ``blank_before`` (paragraph gap), ``indent`` and ``formatted``."""
    block = Window.partitionBy("image_id", "block_num")
    above = F.lag(F.col("y") + F.col("height")).over(block.orderBy("line_ord"))
    height = F.when(F.col("height") > 0, F.col("height")).otherwise(20)
    return (
        lines.withColumn("blank_before", F.coalesce(F.col("y") - above > height * gap, F.lit(False)))
        .withColumn("indent", indent_of(F.col("x") - F.min("x").over(block), F.col("image_width")))
        .withColumn("formatted", indented())
    )


def indented() -> Column:
    return F.concat(F.repeat(F.lit(" "), F.col("indent")), "text")


def format_text(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: formatted lines, blocks in reading order, column count. Lines need ``format_lines``, blocks
    ``reading_order``."""
    placed = lines.join(blocks.select("image_id", "block_num", "read_ord", "column_id"), ["image_id", "block_num"])
    sep = F.when((F.col("line_ord") > 1) & F.col("blank_before"), "\n\n").when(F.col("line_ord") > 1, "\n").when(F.col("read_ord") > 1, "\n\n").otherwise("")
    return placed.groupBy("image_id").agg(
        (F.max("column_id") + 1).alias("column_count"),
        F.countDistinct("block_num").alias("n_blocks"),
        ordered_text(["read_ord", "line_ord"], F.concat(sep, "formatted")).alias("formatted_text"),
    )


def place_lines(lines: DataFrame) -> DataFrame:
    """Lines of ``format_lines`` with their block's box (bx, by, bw, bh), ``block_ord``, ``cx``, ``column_id`` and
    ``read_ord``: what ``build_blocks``, ``detect_columns`` and ``reading_order`` give, as windows on the line rows, so
    that lines need no join with their blocks."""
    page, block = Window.partitionBy("image_id"), Window.partitionBy("image_id", "block_num")
    end = lambda at, size: F.max(F.col(at) + F.col(size)).over(block)
    boxed = lines.withColumn("bx", F.min("x").over(block)).withColumn("by", F.min("y").over(block))
    boxed = boxed.withColumn("bw", end("x", "width") - F.col("bx")).withColumn("bh", end("y", "height") - F.col("by"))
    ordered = boxed.withColumn("block_ord", F.dense_rank().over(page.orderBy("by", "bx", "block_num"))).withColumn("cx", F.col("bx") + F.floor(F.col("bw") / 2))
    # Between lines of one block the centre does not step.
    order = page.orderBy("cx", "block_ord", "line_ord")
    step = F.col("cx") - F.lag("cx").over(order)
    stepped = ordered.withColumn("new", F.when(step > F.floor(F.col("image_width") * COLUMN_GAP), 1).otherwise(0))
    columns = stepped.withColumn("column_id", F.sum("new").over(order)).drop("new")
    return columns.withColumn("read_ord", F.dense_rank().over(page.orderBy("column_id", "by", "cx", "block_ord")))


#: Columns that ``format_lines`` and ``place_lines`` add.
PLACES = ["blank_before", "indent", "formatted", "bx", "by", "bw", "bh", "block_ord", "cx", "column_id", "read_ord"]


def blocks_of(placed: DataFrame) -> DataFrame:
    """The blocks of ``place_lines``, as ``reading_order`` gives them."""
    same = {"x": "bx", "y": "by", "width": "bw", "height": "bh"} | {c: c for c in ("image_width", "block_ord", "cx", "column_id", "read_ord")}
    return placed.groupBy("image_id", "block_num").agg(*[F.max(c).alias(name) for name, c in same.items()], F.count("*").alias("n_lines"), F.sum("n_words").alias("n_words"))


def with_sums(lines: DataFrame) -> DataFrame:
    """Lines with ``sum_conf`` over their words: all that documents need of these."""
    return lines.withColumn("sum_conf", F.aggregate("words", F.lit(0.0), lambda a, w: a + w["conf"]))


def documents_of(placed: DataFrame) -> DataFrame:
    """Per page, from the lines of ``place_lines``: counts, confidence, size, language and the formatted text."""
    sep = F.when((F.col("line_ord") > 1) & F.col("blank_before"), "\n\n").when(F.col("line_ord") > 1, "\n").when(F.col("read_ord") > 1, "\n\n").otherwise("")
    summed = placed if "sum_conf" in placed.columns else with_sums(placed)
    return summed.groupBy("image_id").agg(
        F.sum("n_words").alias("word_count"),
        (F.sum("sum_conf") / F.sum("n_words")).alias("avg_confidence"),
        F.max("image_width").alias("image_width"),
        F.max("image_height").alias("image_height"),
        *[F.max("language").alias("language")] * ("language" in placed.columns),
        (F.max("column_id") + 1).alias("column_count"),
        F.max("block_ord").cast("long").alias("n_blocks"),
        ordered_text(["read_ord", "line_ord"], F.concat(sep, "formatted")).alias("formatted_text"),
    )


def with_empty_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """All pages; those without blocks get the fixed note and one column. Columns of ``texts`` that a page has too are
    the page's."""
    fixed = {"column_count": F.lit(1), "n_blocks": F.lit(0), "word_count": F.lit(0), "formatted_text": F.lit(V.NO_TEXT)}
    own = [c for c in texts.columns if c not in pages.columns]
    return pages.join(texts.select("image_id", *own), "image_id", "left").select(*pages.columns, *[F.coalesce(c, fixed[c]).alias(c) if c in fixed else F.col(c) for c in own])


def line_stats(placed: DataFrame) -> DataFrame:
    """Per page, from the lines of ``place_lines``: total_blocks, total_lines, and its possible headings in order."""
    head = F.when(is_header(), F.struct("block_ord", "line_ord", "text"))
    return placed.groupBy("image_id").agg(
        F.max("block_ord").cast("long").alias("total_blocks"),
        F.count("*").alias("total_lines"),
        F.transform(F.array_sort(F.collect_list(head)), lambda x: x["text"]).alias("headers"),
    )


def document_stats(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: totals, rounded confidence, size, possible headings. ``placed``: lines of ``place_lines``; ``docs``:
    image_id, language, image_width, image_height, word_count, avg_confidence."""
    return docs.join(line_stats(placed), "image_id", "left").select(
        "image_id",
        F.coalesce("total_blocks", F.lit(0)).alias("total_blocks"),
        F.coalesce("total_lines", F.lit(0)).alias("total_lines"),
        F.col("word_count").alias("total_words"),
        F.bround("avg_confidence", 1).alias("avg_confidence"),
        "language",
        F.concat_ws("x", "image_width", "image_height").alias("dimensions"),
        F.coalesce("headers", F.array().cast("array<string>")).alias("headers"),
    )
