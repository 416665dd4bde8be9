"""Word rows: cleaning, radio marks, adaptive thresholds, page-level filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import values as V
from pagewright.functions.text import strip


def filter_words(words: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """Stripped words of at least ``min_conf``, without blanks and single noise characters. Few words have a blank at an end,
    and to look there costs a fraction of stripping."""
    ends = F.substring("text", 1, 1).isin(*V.BLANKS) | F.substring("text", -1, 1).isin(*V.BLANKS)
    return words.withColumn("text", F.when(ends, strip(F.col("text"))).otherwise(F.col("text"))).where((F.col("conf") >= min_conf) & ~F.col("text").isin("", *V.NOISE_CHARS))


def mark_radio(words: DataFrame) -> DataFrame:
    """Small square boxes read as circle-like text become the circle sign."""
    ratio = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    square = (F.col("height") > 0) & ratio.between(0.7, 1.4)
    return words.withColumn("text", F.when(square & F.col("text").isin(V.RADIO_TEXTS) & (F.col("width") < 60), F.lit(V.RADIO)).otherwise(F.col("text")))


def adaptive_filter(words: DataFrame, quality: DataFrame) -> DataFrame:
    """Words that reach their page's ``suggested_confidence``; pages without quality rows keep none."""
    suggested = quality.select("image_id", "suggested_confidence")
    return words.join(suggested, "image_id").where(F.col("conf") >= F.col("suggested_confidence")).drop("suggested_confidence")


def page_account(pages: DataFrame, quality: DataFrame, attempts: DataFrame, docs: DataFrame) -> DataFrame:
    """Every page once, with what became of it: image_id, outcome, attempts and word_count.

    ``attempts``: image_id, attempts (candidates that brought words); ``docs``: image_id, word_count. The outcome is
    ``exported``, or the first that holds of ``no_quality`` (no row of image quality, so no threshold), ``all_failed``
    (no candidate brought a word) and ``empty`` (no word was left). All joins are on the page.
    """
    every = pages.select("image_id").distinct()
    rated = quality.select("image_id", F.lit(True).alias("rated")).distinct()
    joined = every.join(rated, "image_id", "left").join(attempts.select("image_id", "attempts"), "image_id", "left").join(docs.select("image_id", "word_count"), "image_id", "left")
    counted = joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("attempts", "word_count")})
    outcome = F.when(F.col("rated").isNull(), "no_quality").when(F.col("attempts") == 0, "all_failed").when(F.col("word_count") == 0, "empty").otherwise("exported")
    return counted.select("image_id", outcome.alias("outcome"), "attempts", "word_count")


def rejected_pages(account: DataFrame) -> DataFrame:
    """The pages of ``page_account`` that nothing is exported for, with the reason as a note."""
    notes = {"no_quality": "no quality row", "all_failed": "no candidate brought words", "empty": "no word was left"}
    note = F.coalesce(*[F.when(F.col("outcome") == k, v) for k, v in notes.items()])
    return account.where("outcome != 'exported'").select("image_id", "outcome", note.alias("note"), "attempts")


def drop_empty_results(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with words, and those without."""
    empty = F.coalesce(F.col("word_count"), F.lit(0)) == 0
    return docs.where(~empty), docs.where(empty)


def is_header() -> Column:
    return (F.col("n_words") <= 6) & (F.col("y") < F.col("image_height") * 0.15)


def header_lines(lines: DataFrame) -> DataFrame:
    """Possible headings: short lines near the top of the page."""
    return lines.where(is_header())


def filter_regions(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Regions with text that cover a fiftieth of their image or more."""
    text = strip(F.col("text"))
    big = F.col("w") * F.col("h") >= F.col("height") * F.col("width") * 0.02
    return regions.join(images.select("image_id", "height", "width"), "image_id").where(big & (text != "")).select(
        "image_id",
        F.lit("imagen_con_texto").alias("tipo"),
        F.array("x", "y", "w", "h").alias("coordenadas"),
        text.alias("texto"),
        F.format_string("[Región (%d,%d) — %dx%dpx]", "x", "y", "w", "h").alias("descripcion"),
    )
