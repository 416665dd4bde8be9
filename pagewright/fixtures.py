"""Recogniser tables, exam texts and images derived arithmetically from the given tables.

Each is one SQL text. Lines and tokens are derived apart for Spark and DuckDB; Spark's tokens bring their document's number
of lines and their place in the line with them, so that no window, and so no exchange or sort of words, is needed there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import once
from pagewright.tables import bucketed, buckets_of

SPARK_LINES = "SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, chr(10))) a AS line_no, line"
DUCK_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
DUCK_TOKENS = "SELECT doc_id, line_no, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no, unnest(string_split(line, ' ')) AS word FROM lines0"

#: Word boxes: two columns of blocks of five lines, steps and gaps that exercise layout, a circle-like word here and there.
OCR_WORDS = """
SELECT doc_id AS image_id, 0 AS variant, 3 AS psm, 'spa' AS language, 2800 AS image_width,
       CAST(40 * (max(line_no) OVER (PARTITION BY doc_id) + 1) + 200 AS INT) AS image_height,
       line_no * 100000 + word_no AS ord,
       CASE WHEN (line_no * 7 + word_no) % 11 = 10 THEN 'O' ELSE word END AS text,
       CAST((doc_id * 31 + line_no * 17 + word_no * 7) % 101 AS DOUBLE) AS conf,
       CAST((CAST(floor(line_no / 5) AS BIGINT) % 2) * 1600 + (line_no % 4) * 35
            + 10 * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + CASE WHEN word_no % 7 = 6 THEN 60 ELSE 0 END AS INT) AS `left`,
       CAST(40 * line_no + CASE WHEN line_no % 6 = 5 THEN 90 ELSE 0 END AS INT) AS top,
       CAST(CASE WHEN (line_no * 7 + word_no) % 11 = 10 THEN 30 ELSE 10 * length(word) END AS INT) AS width, 30 AS height,
       CAST(floor(line_no / 5) AS INT) AS block_num, 1 AS par_num, CAST(line_no % 5 AS INT) AS line_num, CAST(word_no AS INT) AS word_num
FROM tokens
"""

#: The windows in ``OCR_WORDS``, and the columns of Spark's tokens that hold the same.
IN_PLACE = {
    "(max(line_no) OVER (PARTITION BY doc_id) + 1)": "n_lines",
    "coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)": "at",
}
#: Words in a piece of a line, and in a piece of that.
PIECES = (1024, 32)

#: Texts with question heads, code, options and blank lines, all set in as lines of their own between the given ones;
#: every third document has options only, every fifth none.
EXAM_LINES = """
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY place) - 1 AS line_no, line FROM (
  SELECT doc_id AS image_id, 2 * line_no + 1 AS place,
         CASE WHEN doc_id % 5 = 4 THEN line
              WHEN line_no % 8 = 1 THEN line || ':'
              WHEN line_no % 8 = 4 THEN 'O ' || line
              WHEN line_no % 8 = 5 THEN 'a) ' || line
              ELSE line END AS line
  FROM lines0
  UNION ALL
  SELECT doc_id AS image_id, 2 * line_no AS place,
         CASE line_no % 8 WHEN 0 THEN 'Pregunta ' || CAST(line_no AS STRING) WHEN 2 THEN 'x = ' || CAST(line_no AS STRING) WHEN 3 THEN 'print(x)' ELSE '' END AS line
  FROM lines0 WHERE doc_id % 5 <> 4 AND (line_no % 8 IN (2, 3, 6) OR (line_no % 8 = 0 AND doc_id % 3 <> 2)))
"""

#: Whole lines with literals that trigger every repair rule; literals that must stand alone are lines of their own.
DIRTY_LINES = """
SELECT doc_id AS image_id, 2 * line_no + 1 AS line_no,
       CASE line_no % 25
         WHEN 0 THEN '“' || line || '” — ﬁn ﬂor «a» „b’'
         WHEN 1 THEN 'str(¡+1) (¡) x=¡+1 ¡hola ' || line
         WHEN 2 THEN '____esun ' || line || ' snake_case'
         WHEN 3 THEN 'O' || line
         WHEN 4 THEN 'o ' || line
         WHEN 5 THEN '() ' || line
         WHEN 6 THEN '[]' || line
         WHEN 7 THEN '[x] ' || line || ' [V]si'
         WHEN 8 THEN line || ' © ' || line
         WHEN 9 THEN '   ' || line || '    ' || line || '  b'
         WHEN 10 THEN 'Ist Ien iflint ifllint prinl printt inpul (' || line
         WHEN 11 THEN 'Genero  (M/P) o (M/P) ' || line
         WHEN 12 THEN 'esun esuna noexiste noes dela delante delos porquees ' || line
         WHEN 13 THEN 'diferencía funcíón operacíón condícíón varíable ' || line
         WHEN 14 THEN '1l0 y 1O0 y 2l3 al ' || line
         WHEN 15 THEN '............ ------------ ____________ ' || line
         WHEN 19 THEN 'b. ' || line
         WHEN 20 THEN 'Orden ' || line
         WHEN 22 THEN '0.' || line
         WHEN 23 THEN '© ' || line
         ELSE line END AS line
FROM lines0
UNION ALL
SELECT doc_id AS image_id, 2 * line_no AS line_no, CASE line_no % 25 WHEN 16 THEN '||' WHEN 17 THEN 'ab' WHEN 18 THEN '○' ELSE 'O rden' END AS line
FROM lines0 WHERE line_no % 25 IN (16, 17, 18, 21)
"""

#: Six variants in two modes, with shifted confidences and lost words.
CANDIDATE_WORDS = """
SELECT image_id, CAST(v AS INT) AS variant, CAST(p AS INT) AS psm, language, image_width, image_height, ord, text, `left`, top, width, height, block_num, par_num, line_num, word_num,
       CAST(least(100, greatest(0, conf + (v * 13 + p * 5) % 29)) AS DOUBLE) AS conf
FROM ocr_words, (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) a, (SELECT 3 AS p UNION ALL SELECT 6) b
WHERE (word_num + v) % (p + 2) <> 0
"""

SEGMENTS = """
SELECT l_orderkey AS image_id, CASE WHEN l_linenumber % 2 = 0 THEN 'skew' ELSE 'layout' END AS purpose,
       CAST(l_partkey % 97 AS INT) AS x1, CAST(l_suppkey % 53 AS INT) AS y1, CAST(l_partkey % 97 + 200 AS INT) AS x2, CAST(l_suppkey % 53 + l_partkey % 61 - 30 AS INT) AS y2
FROM {lineitem}
"""
CONTOURS = "SELECT l_partkey AS image_id, CAST(l_quantity AS DOUBLE) AS area FROM {lineitem}"
IMAGE_SIZES = "SELECT p_partkey AS image_id, CAST(200 + p_partkey % 4000 AS INT) AS width, CAST(150 + p_size * 60 AS INT) AS height FROM {part}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(pieces: DataFrame, n: int) -> DataFrame:
    """Pieces of lines (first: number of the first word, start: its place, piece) as pieces of up to ``n`` words."""

    def part(words: Column, k: Column) -> Column:
        before = F.when(k == 0, 0).otherwise(F.length(F.array_join(F.slice(words, F.lit(1), k * n), " ")) + 1)
        return F.struct((F.col("first") + k * n).alias("first"), (F.col("start") + before).alias("start"), F.array_join(F.slice(words, k * n + 1, F.lit(n)), " ").alias("piece"))

    parts = once(F.split("piece", " "), lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / n).cast("int")), lambda k: part(words, k)))
    return pieces.select("doc_id", "n_lines", "line_no", F.inline(parts))


def tokens(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, line_no, word_no, word, at: the words of each document where it lies. ``at`` is the sum of the lengths
    of the words before it in its line and of a blank after each: looked up in a short piece, however long the line is.
    ``doc_id`` is the key of ``documents``."""
    per_line = documents.select("doc_id", F.split("text", "\n").alias("lines")).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("line_no", "piece"))
    pieces = per_line.select("doc_id", "n_lines", F.col("line_no").cast("long").alias("line_no"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("start"), "piece")
    for n in PIECES:
        pieces = cut(pieces, n)
    words = pieces.select("*", F.posexplode(F.split("piece", " ")).alias("i", "word"))
    at = F.col("start") + F.when(F.col("i") == 0, 0).otherwise(F.length(F.expr("substring_index(piece, ' ', i)")) + 1)
    return words.select("doc_id", "n_lines", "line_no", (F.col("first") + F.col("i")).alias("word_no"), "word", at.alias("at"))


def _derived(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Words come from documents that are dealt by page before words are derived from them, into as many parts as a table
    has buckets: a document is far smaller than its word rows, and grouping, windows and joins of these by page need no
    exchange."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    if "ocr_words" not in body:
        return spark.sql(f"WITH lines0 AS ({SPARK_LINES}) {body}", documents=documents)
    words = OCR_WORDS.replace("FROM tokens", "FROM {tokens}")
    for window, column in IN_PLACE.items():
        words = words.replace(window, column)
    return spark.sql(f"WITH ocr_words AS ({words}) {body}", tokens=tokens(documents.repartition(buckets_of(spark), "doc_id")))


#: Derived tables that were written in buckets by page, by name and folder of the given tables.
_prepared: dict[tuple[str, str], DataFrame] = {}


def prepare(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Write ``ocr_words`` or ``candidate_words`` in buckets by page; later calls for them read that table."""
    df = {"ocr_words": ocr_words, "candidate_words": candidate_words}[name](spark, sf_dir)
    _prepared[name, sf_dir] = bucketed(df, "image_id")
    return _prepared[name, sf_dir]


def forget(sf_dir: str) -> None:
    for name in ("ocr_words", "candidate_words"):
        _prepared.pop((name, sf_dir), None)


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared[found] if (found := ("ocr_words", sf_dir)) in _prepared else _derived(spark, sf_dir, "SELECT * FROM ocr_words")


def candidate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared[found] if (found := ("candidate_words", sf_dir)) in _prepared else _derived(spark, sf_dir, CANDIDATE_WORDS)


def exam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, EXAM_LINES)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, DIRTY_LINES)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS, lineitem=_table(spark, sf_dir, "lineitem"))


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CONTOURS, lineitem=_table(spark, sf_dir, "lineitem"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(IMAGE_SIZES, part=_table(spark, sf_dir, "part"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images of the embeddings: values from lowest to highest as 0 to 255; where all are equal, 128."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    lo, hi = F.array_min("v"), F.array_max("v")
    hexed = F.transform("v", lambda x: F.lpad(F.hex(F.when(hi > lo, F.floor((x - lo) / (hi - lo) * 255)).otherwise(128)), 2, "0"))
    image = F.struct(F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), F.unhex(F.array_join(hexed, "")).alias("data"))
    return e.select(F.col("vec_id").alias("image_id"), image.alias("image"))


#: Cells of a large image a side, and their height and width in pixels (taller ones for odd ids).
CELLS, CELL_HEIGHT, CELL_WIDTH = 12, 60, 60


def large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 720 pixels or more a side, each put together from three of ``images``: their values, one after the
    other and again from the first, as 12 x 12 squares."""
    three = images(spark, sf_dir).groupBy(F.floor(F.col("image_id") / 3).cast("long").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("image_id", F.hex("image.data").alias("h")))).alias("parts"))
    hexed = three.select("image_id", F.array_join(F.transform("parts", lambda p: p["h"]), "").alias("h"), (F.col("image_id") % 2 * 10 + CELL_HEIGHT).cast("int").alias("tall"))
    cell = lambda r, c: F.substr("h", (r * CELLS + c) * 2 % F.length("h") + 1, F.lit(2))
    side = F.sequence(F.lit(0), F.lit(CELLS - 1))
    line = lambda r: F.array_join(F.transform(side, lambda c: F.repeat(cell(r, c), CELL_WIDTH)), "")
    data = F.unhex(F.array_join(F.transform(side, lambda r: F.repeat(line(r), F.col("tall"))), ""))
    image = F.struct(F.lit("").alias("origin"), (F.col("tall") * CELLS).alias("height"), F.lit(CELL_WIDTH * CELLS).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    return hexed.select("image_id", image.alias("image"))


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and content of a bitmap file for each of ``images``; by the id modulo 11 some have another suffix, no content
    or a part of it only."""
    pixels = F.hex("image.data")
    row = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.repeat(F.substr(pixels, (r * 8 + c) * 2 + 1, F.lit(2)), 3)), "")
    #: Header of an 8 x 8 bitmap of 24 bits, whose rows go from the bottom up.
    header = "424DF600000000000000" + "36000000" + "28000000" + "08000000" * 2 + "01001800" + "00000000" + "C0000000" + "130B0000" * 2 + "00000000" * 2
    whole = F.concat(F.lit(header), F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), row), ""))
    kind = F.col("image_id") % 11
    suffix = F.when(kind == 3, ".txt").when(kind == 9, ".BMP").otherwise(".bmp")
    content = F.when(kind == 5, "").when(kind == 7, F.substring(whole, 1, 60)).otherwise(whole)
    return images(spark, sf_dir).select(F.concat(F.lit("scan"), "image_id", suffix).alias("name"), F.unhex(content).alias("content"))


def duck(body: str) -> str:
    """The same derived tables as DuckDB's common table expressions, before ``body``."""
    fix = lambda s: s.replace("`left`", '"left"').replace("AS STRING", "AS VARCHAR").replace("{lineitem}", "lineitem").replace("{part}", "part")
    parts = {"lines0": DUCK_LINES, "tokens": DUCK_TOKENS, "ocr_words": OCR_WORDS, "exam_lines": EXAM_LINES, "dirty_lines": DIRTY_LINES, "candidate_words": CANDIDATE_WORDS, "segments": SEGMENTS, "contours": CONTOURS, "image_sizes": IMAGE_SIZES}
    needed = [k for k in parts if k in body]
    grown = True
    while grown:
        more = [k for k in parts if k not in needed and any(k in parts[n] for n in needed)]
        grown = bool(more)
        needed += more
    return "WITH " + ", ".join(f"{k} AS ({fix(parts[k])})" for k in parts if k in needed) + fix(body)
