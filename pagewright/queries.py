"""One query per operator, over the given tables or inputs derived from them, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import fixtures as X
from pagewright.functions import rules as R
from pagewright.functions import text as T
from pagewright.functions import values as V
from pagewright.operators import candidates as C
from pagewright.operators import exam as E
from pagewright.operators import images as I
from pagewright.operators import layout as L
from pagewright.operators import words as W
from pagewright.plans.rounds import Rounds, recognise_in_rounds
from pagewright.plans.workflows import lay_out, plan_recognition, recognised_account, recognised_documents
from pagewright.sources import io as S
from pagewright.sources.files import read_files, write_files
from pagewright.tables import bucketed, new_folder, saved

MIN_CONF = 8.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Common table expressions of the oracles, in order of dependence.
SPACE_SQL = r"regexp_replace({}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


def trim(c: str) -> str:
    return SPACE_SQL.format(c)


RADIO_SQL = ", ".join(f"'{t}'" for t in V.RADIO_TEXTS)
SINGLES_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in V.USEFUL_SINGLES)

CTES = {
    "words": f"""SELECT image_id, block_num, par_num * 1000 + line_num AS line_key, ord, word_num, "left", top, width, height, conf, image_width, image_height,
      CASE WHEN height > 0 AND width::DOUBLE / greatest(height, 1) BETWEEN 0.7 AND 1.4 AND t IN ({RADIO_SQL}) AND width < 60 THEN '○' ELSE t END AS text
      FROM (SELECT *, {trim('text')} AS t FROM ocr_words) WHERE t <> '' AND conf >= {MIN_CONF} AND t NOT IN ('|', '~', '`', '^')""",
    "gaps": 'SELECT *, "left" - lag("left" + width) OVER (PARTITION BY image_id, block_num, line_key ORDER BY "left", ord) AS gap FROM words',
    "usual": "SELECT image_id, block_num, line_key, greatest(coalesce(g[len(g) // 2 + 1], 1), 1) AS u FROM (SELECT image_id, block_num, line_key, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM gaps GROUP BY ALL)",
    "plines": """SELECT *, row_number() OVER (PARTITION BY image_id, block_num ORDER BY y, line_key) AS line_ord FROM (
      SELECT g.image_id, g.block_num, g.line_key, min("left") AS x, min(top) AS y, max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height,
        max(image_width) AS image_width, max(image_height) AS image_height, count(*) AS n_words,
        string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap::DOUBLE / u > 3 THEN '   ' ELSE ' ' END || text, '' ORDER BY "left", ord) AS text
      FROM gaps g JOIN usual m ON g.image_id = m.image_id AND g.block_num = m.block_num AND g.line_key = m.line_key GROUP BY g.image_id, g.block_num, g.line_key)""",
    "blocks": """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x, block_num) AS block_ord FROM (
      SELECT image_id, block_num, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, max(image_width) AS image_width, count(*) AS n_lines
      FROM plines GROUP BY image_id, block_num)""",
    "placed": """SELECT *, CAST(sum(CASE WHEN step > floor(image_width * 0.15) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY cx, block_ord) AS BIGINT) AS column_id FROM (
      SELECT *, cx - lag(cx) OVER (PARTITION BY image_id ORDER BY cx, block_ord) AS step FROM (SELECT *, x + width // 2 AS cx FROM blocks))""",
    "reading": "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY column_id, y, cx, block_ord) AS read_ord FROM placed",
    "formatted": """SELECT *, repeat(' ', CAST(indent AS BIGINT)) || text AS formatted FROM (
      SELECT *, coalesce(y - above > (CASE WHEN height > 0 THEN height ELSE 20 END) * 1.8, false) AS blank_before,
        CASE WHEN px < 15 OR image_width = 0 THEN 0 ELSE least(20, floor(px::DOUBLE / image_width * 80)) END AS indent
      FROM (SELECT *, lag(y + height) OVER (PARTITION BY image_id, block_num ORDER BY line_ord) AS above, x - min(x) OVER (PARTITION BY image_id, block_num) AS px FROM plines))""",
    "texts": """SELECT f.image_id, max(column_id) + 1 AS column_count, count(DISTINCT f.block_num) AS n_blocks,
      string_agg(CASE WHEN line_ord > 1 AND blank_before THEN chr(10) || chr(10) WHEN line_ord > 1 THEN chr(10) WHEN read_ord > 1 THEN chr(10) || chr(10) ELSE '' END || formatted, '' ORDER BY read_ord, line_ord) AS formatted_text
      FROM formatted f JOIN reading r ON f.image_id = r.image_id AND f.block_num = r.block_num GROUP BY f.image_id""",
    "counts": "SELECT image_id, count(*) AS word_count, avg(conf) AS avg_confidence, max(image_width) AS image_width, max(image_height) AS image_height FROM words GROUP BY image_id",
    "cand": f"SELECT image_id, variant, psm, {trim('text')} AS text, conf, ord FROM candidate_words WHERE {trim('text')} <> '' AND conf >= {MIN_CONF} AND {trim('text')} NOT IN ('|', '~', '`', '^')",
    "scores": f"""SELECT image_id, variant, psm, len(c) AS real_words, coalesce(len(c) * c[len(c) // 2 + 1], 0.0) AS score, word_count, avg_confidence, CASE psm WHEN 3 THEN 1 ELSE 2 END AS psm_rank,
      CASE WHEN variant >= 3 THEN '2' WHEN psm = 3 THEN '1A' ELSE '1B' END AS phase
      FROM (SELECT image_id, variant, psm, list_sort(coalesce(list(conf) FILTER (length(text) >= 2 OR text IN ({SINGLES_SQL})), [])) AS c, count(*) AS word_count, avg(conf) AS avg_confidence FROM cand GROUP BY ALL)""",
    "phases": """SELECT *, coalesce(max(score) FILTER (phase = '1A') OVER (PARTITION BY image_id), -1) AS a, coalesce(max(score) FILTER (phase <> '2') OVER (PARTITION BY image_id), -1) AS ab FROM scores""",
    "best": """SELECT image_id, variant, psm, score, phase FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, phase, variant, psm_rank) AS place FROM phases
      WHERE phase = '1A' OR (phase = '1B' AND a < 2400) OR (phase = '2' AND ab < 2400)) WHERE place = 1""",
    "marked": f"""SELECT *, regexp_matches(s, '^(Pregunta\\s+\\d+|\\d{{1,3}}[.)\\-]\\s+[A-ZÁÉÍÓÚÑ¿¡]|Q\\d{{1,3}}[.:)]\\s)', 'i') AS is_head, regexp_matches(s, '^([○☐☑]|[a-dA-D][).])\\s') AS is_option
      FROM (SELECT image_id, line_no, line, {trim('line')} AS s FROM exam_lines)""",
    "segs": "SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY line_no) AS q_no FROM marked",
    "bodies": """SELECT *, line_no - lo AS j FROM (SELECT *, min(line_no) FILTER (s <> '') OVER (PARTITION BY image_id, q_no) AS lo, max(line_no) FILTER (s <> '') OVER (PARTITION BY image_id, q_no) AS hi
      FROM segs WHERE q_no > 0 AND NOT is_head) WHERE line_no BETWEEN lo AND hi""",
    "ends": """SELECT *, coalesce(min(j) FILTER (stop) OVER (PARTITION BY image_id, q_no) + 1, max(j) OVER (PARTITION BY image_id, q_no) + 1) AS rest_start FROM (
      SELECT *, CASE WHEN s = '' THEN NOT (coalesce(regexp_matches(nxt, '^[\\p{Ll}]'), false) OR (NOT regexp_matches(prv, '[:.?]$') AND len(string_split_regex(nxt, '\\s+')) >= 2))
        ELSE regexp_matches(s, '[:.?]$') OR nxt IS NULL OR (NOT regexp_matches(nxt, '^[\\p{Ll}]') AND len(string_split_regex(nxt, '\\s+')) < 2 AND length(nxt) < length(s) * 0.4) END AS stop
      FROM (SELECT *, first_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER (PARTITION BY image_id, q_no ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
        last_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER (PARTITION BY image_id, q_no ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv FROM bodies))""",
    "coded": "SELECT *, {code} AS is_code FROM ends WHERE s <> ''",
    "parts0": """SELECT *, CASE WHEN j < rest_start THEN 'statement' WHEN j >= ft THEN 'option' ELSE 'code' END AS part0 FROM (
      SELECT *, min(j) FILTER (j >= rest_start AND NOT is_code) OVER (PARTITION BY image_id, q_no) AS ft FROM coded)""",
    "parts": """SELECT *, CASE WHEN part0 = 'code' AND n_code >= 3 AND n_option = 0 AND back <= 3 THEN 'option' ELSE part0 END AS part FROM (
      SELECT *, count(*) FILTER (part0 = 'code') OVER w AS n_code, count(*) FILTER (part0 = 'option') OVER w AS n_option, row_number() OVER (PARTITION BY image_id, q_no ORDER BY j DESC) AS back
      FROM parts0 WINDOW w AS (PARTITION BY image_id, q_no))""",
}
CODE_SQL = "(" + " OR ".join([f"regexp_matches(s, '{p}')" for p in V.CODE_PATTERNS] + [f"contains(s, '{o}')" for o in V.CODE_OPERATORS]) + ")"
CTES["coded"] = CTES["coded"].format(code=CODE_SQL)


def sql(body: str) -> str:
    """``body`` behind the common table expressions and derived inputs that it needs."""
    import re

    uses = lambda text, name: re.search(rf"\b{name}\b", text) is not None
    names = list(CTES)
    needed: set[str] = set()
    todo = [n for n in names if uses(body, n)]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += [m for m in names if m != n and uses(re.sub(r"AS \w+", "", CTES[n]), m)]
    own = ", ".join(f"{n} AS ({CTES[n]})" for n in names if n in needed)
    base = X.duck(f" /*x*/ {own} {body}")
    if not own:
        return base.replace(" /*x*/  ", " ").replace("WITH  ", "")
    return base.replace(" /*x*/ ", ", " if not base.startswith("WITH  /*x*/") else " ", 1)


def half_even(c: str, digits: int) -> str:
    x = f"({c} * {10**digits})"
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN (floor({x}) + floor({x}) % 2) / {10**digits} ELSE round({c}, {digits}) END"


def pages(spark: SparkSession, sf_dir: str, keep_words: bool = False):
    return lay_out(X.ocr_words(spark, sf_dir), MIN_CONF, post_process=False, repair=False, dealt=True, keep_words=keep_words)


def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(L.detect_columns(L.build_blocks(line_rows(spark, sf_dir))))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_lines(kept_words(spark, sf_dir))


def kept_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.mark_radio(W.filter_words(X.ocr_words(spark, sf_dir), MIN_CONF))


# Words.
@query("w1_filter_words", sql(f"SELECT image_id, ord, {trim('text')} AS text, conf FROM ocr_words WHERE {trim('text')} <> '' AND conf >= {MIN_CONF} AND {trim('text')} NOT IN ('|', '~', '`', '^')"))
def w1(spark, d):
    return W.filter_words(X.ocr_words(spark, d), MIN_CONF).select("image_id", "ord", "text", "conf")


@query("w2_mark_radio", sql("SELECT image_id, ord, text FROM words WHERE text = '○'"))
def w2(spark, d):
    return kept_words(spark, d).where(F.col("text") == V.RADIO).select("image_id", "ord", "text")


@query("w3_adaptive_filter", sql("SELECT image_id, count(*) AS n, sum(conf) AS conf FROM ocr_words WHERE conf >= (CASE image_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 3 END) GROUP BY image_id"))
def w3(spark, d):
    words = X.ocr_words(spark, d)
    quality = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 3 == 0, 15.0).when(F.col("doc_id") % 3 == 1, 8.0).otherwise(3.0).alias("suggested_confidence"))
    return W.adaptive_filter(words, quality).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"))


@query("w4_parse_languages", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '+eng' WHEN 1 THEN lang WHEN 2 THEN 'spa' ELSE lang || '+' || source END AS languages FROM documents")
def w4(spark, d):
    given = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(' ', lang, ' , eng,,') WHEN 1 THEN lang WHEN 2 THEN ' + ,' ELSE concat(lang, '+ ', source) END")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.parse_languages(given).alias("languages"))


@query("w5_drop_empty_results", "SELECT doc_id AS image_id, word_count FROM (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: length(x) > 12)) AS word_count FROM documents) WHERE word_count > 0")
def w5(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.size(F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 12)).cast("long").alias("word_count"))
    return W.drop_empty_results(docs)[0]


@query("w6_header_lines", sql("SELECT image_id, block_num, line_key, text, n_words FROM plines WHERE n_words <= 6 AND y < image_height * 0.15"))
def w6(spark, d):
    return W.header_lines(L.build_lines(kept_words(spark, d))).select("image_id", "block_num", "line_key", "text", F.col("n_words").cast("long").alias("n_words"))


REGION = "l_orderkey AS image_id, CAST(l_partkey % 50 AS INT) AS x, CAST(l_suppkey % 40 AS INT) AS y, CAST(l_quantity AS INT) AS w, CAST(l_linenumber * 9 AS INT) AS h"


@query("w7_filter_regions", f"""SELECT image_id, 'imagen_con_texto' AS tipo, x || ',' || y || ',' || w || ',' || h AS coordenadas, trim(t) AS texto,
  '[Región (' || x || ',' || y || ') — ' || w || 'x' || h || 'px]' AS descripcion
  FROM (SELECT {REGION}, CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE ' ' || l_returnflag || ' ' END AS t FROM lineitem) r JOIN orders o ON o.o_orderkey = r.image_id
  WHERE w * h >= (o_custkey % 90 + 10) * 120 * 0.02 AND trim(t) <> ''""")
def w7(spark, d):
    regions = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*["l_orderkey AS image_id", "CAST(l_partkey % 50 AS INT) AS x", "CAST(l_suppkey % 40 AS INT) AS y", "CAST(l_quantity AS INT) AS w", "CAST(l_linenumber * 9 AS INT) AS h", "CASE WHEN l_linenumber % 3 = 0 THEN '  ' ELSE concat(' ', l_returnflag, ' ') END AS text"])
    sizes = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS image_id", "CAST(o_custkey % 90 + 10 AS INT) AS height", "120 AS width")
    return W.filter_regions(regions, sizes).withColumn("coordenadas", F.concat_ws(",", "coordenadas"))


@query("w8_preview", f"""SELECT doc_id, CASE WHEN len(l) > 15 THEN array_to_string(l[1:15], chr(10)) || chr(10) || '... (' || (len(l) - 15) || ' líneas más)' ELSE text END AS preview
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def w8(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.preview(F.col("text")).alias("preview"))


# Layout.
@query("l1_build_lines", sql("SELECT image_id, block_num, line_key, x, y, width, height, n_words FROM plines"))
def l1(spark, d):
    return line_rows(spark, d).select("image_id", "block_num", "line_key", "x", "y", "width", "height", F.col("n_words").cast("long").alias("n_words"))


@query("l2_join_words", sql("SELECT image_id, block_num, line_key, text FROM plines"))
def l2(spark, d):
    return line_rows(spark, d).select("image_id", "block_num", "line_key", "text")


@query("l3_build_blocks", sql("SELECT image_id, block_num, x, y, width, height, n_lines, block_ord FROM blocks"))
def l3(spark, d):
    return L.build_blocks(line_rows(spark, d)).select("image_id", "block_num", "x", "y", "width", "height", "n_lines", F.col("block_ord").cast("long").alias("block_ord"))


@query("l4_raw_text", sql("""SELECT l.image_id, string_agg(CASE WHEN line_ord > 1 THEN chr(10) WHEN block_ord > 1 THEN chr(10) || chr(10) ELSE '' END || text, '' ORDER BY block_ord, line_ord) AS raw_text
  FROM plines l JOIN blocks b ON l.image_id = b.image_id AND l.block_num = b.block_num GROUP BY l.image_id"""))
def l4(spark, d):
    p = pages(spark, d)
    return L.raw_text(p.lines, p.blocks)


@query("l5_detect_columns", sql("SELECT image_id, column_id, min(x) AS x_start, max(x + width) AS x_end, string_agg(CAST(block_num AS VARCHAR), ',' ORDER BY cx, block_ord) AS block_ids FROM placed GROUP BY image_id, column_id"))
def l5(spark, d):
    return L.columns_of(L.detect_columns(L.build_blocks(line_rows(spark, d)))).withColumn("block_ids", F.concat_ws(",", F.transform("block_ids", lambda b: b.cast("string"))))


@query("l6_reading_order", sql("SELECT image_id, block_num, column_id, read_ord FROM reading"))
def l6(spark, d):
    return block_rows(spark, d).select("image_id", "block_num", "column_id", F.col("read_ord").cast("long").alias("read_ord"))


@query("l7_format_lines", sql("SELECT image_id, block_num, line_key, blank_before, CAST(indent AS BIGINT) AS indent, formatted FROM formatted"))
def l7(spark, d):
    return L.format_lines(line_rows(spark, d)).select("image_id", "block_num", "line_key", "blank_before", F.col("indent").cast("long").alias("indent"), "formatted")


@query("l8_format_text", sql("""SELECT d.image_id, coalesce(column_count, 1) AS column_count, coalesce(n_blocks, 0) AS n_blocks, coalesce(formatted_text, '[Sin texto detectado]') AS formatted_text
  FROM (SELECT DISTINCT image_id FROM ocr_words) d LEFT JOIN texts t ON d.image_id = t.image_id"""))
def l8(spark, d):
    every = X.ocr_words(spark, d).select("image_id").distinct()
    lines = bucketed(line_rows(spark, d).drop("words"), "image_id", dealt=True, codec="zstd")
    return L.with_empty_pages(every, L.format_text(L.format_lines(lines), L.reading_order(L.detect_columns(L.build_blocks(lines)))))


@query("l10_document_stats", sql(f"""SELECT c.image_id, s.total_blocks, s.total_lines, word_count AS total_words, {half_even('avg_confidence', 1)} AS avg_confidence, 'spa' AS language, image_width || 'x' || image_height AS dimensions, coalesce(h.headers, '') AS headers
  FROM counts c JOIN (SELECT image_id, count(DISTINCT block_num) AS total_blocks, count(*) AS total_lines FROM plines GROUP BY image_id) s ON c.image_id = s.image_id
  LEFT JOIN (SELECT l.image_id, string_agg(text, '|' ORDER BY block_ord, line_ord) AS headers FROM plines l JOIN blocks b ON l.image_id = b.image_id AND l.block_num = b.block_num
    WHERE n_words <= 6 AND l.y < image_height * 0.15 GROUP BY l.image_id) h ON c.image_id = h.image_id"""))
def l10(spark, d):
    p = pages(spark, d)
    return L.document_stats(p.placed, p.docs).withColumn("headers", F.concat_ws("|", "headers"))


# Candidates.
def cand_words(spark, d) -> DataFrame:
    return W.filter_words(X.candidate_words(spark, d), MIN_CONF)


def with_rank(scores: DataFrame) -> DataFrame:
    return scores.withColumn("psm_rank", F.when(F.col("psm") == 3, 1).otherwise(2))


@query("c1_task_grid", """SELECT image_id, CAST(v AS INT) AS variant, CASE WHEN (r = 1) = (image_id % 3 = 0) THEN 6 ELSE 3 END AS psm, r AS psm_rank, CASE WHEN v >= 3 THEN '2' WHEN r = 1 THEN '1A' ELSE '1B' END AS phase
  FROM (SELECT doc_id AS image_id, unnest(range(CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 5 END)) AS v FROM documents), (SELECT unnest([1, 2]) AS r)""")
def c1(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"))
    rank = docs.select("image_id", F.when(F.col("image_id") % 3 == 0, F.array(F.lit(6), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(6))).alias("psm_order"))
    return C.task_grid(docs.withColumn("is_screenshot", F.col("image_id") % 2 == 0), rank)


@query("c2_score_candidates", sql("SELECT image_id, variant, psm, real_words, score, word_count, avg_confidence FROM scores"))
def c2(spark, d):
    return C.score_candidates(cand_words(spark, d))


@query("c3_select_best", sql("SELECT image_id, variant, psm, score, phase FROM best"))
def c3(spark, d):
    return C.select_best(with_rank(C.score_candidates(cand_words(spark, d)))).select("image_id", "variant", "psm", "score", "phase")


@query("c4_pending_tasks", sql("""SELECT image_id, CAST(v AS INT) AS variant, p AS psm, CASE WHEN v < 3 THEN '1B' ELSE '2' END AS phase FROM (SELECT DISTINCT image_id FROM scores), (SELECT unnest(range(0, 6)) AS v), (SELECT unnest([3, 6]) AS p)
  WHERE (v < 3 AND p = 6 AND image_id NOT IN (SELECT image_id FROM scores WHERE phase = '1A' AND score >= 2400))
    OR (v >= 3 AND image_id NOT IN (SELECT image_id FROM scores WHERE phase <> '2' AND score >= 2400))"""))
def c4(spark, d):
    scores = with_rank(saved(C.score_candidates(cand_words(spark, d)).select("image_id", "variant", "psm", "score")))
    grid = C.task_grid(scores.select("image_id").distinct().withColumn("is_screenshot", F.lit(True)))
    return C.pending_tasks(grid, scores, "1B").unionByName(C.pending_tasks(grid, scores, "2")).select("image_id", "variant", "psm", "phase")


@query("c5_keep_winner_words", sql("SELECT c.image_id, c.variant, c.psm, count(*) AS n, sum(conf) AS conf FROM cand c JOIN best b ON c.image_id = b.image_id AND c.variant = b.variant AND c.psm = b.psm GROUP BY ALL"))
def c5(spark, d):
    rank = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.array(F.lit(3), F.lit(6)).alias("psm_order"))
    picked = C.keep_winner_words(cand_words(spark, d), rank, pick_from=X.candidate_words(spark, d))
    return W.filter_words(picked, MIN_CONF).groupBy("image_id", "variant", "psm").agg(F.count("*").alias("n"), F.sum("conf").alias("conf"))


def rounds_over_scores(spark, d):
    """Three rounds over all documents as pages; the scores of derived candidates answer their tasks."""
    ids = page_ids(spark, d)
    scores = saved(C.score_candidates(cand_words(spark, d)).select("image_id", "variant", "psm", "score"))
    modes = F.when(F.col("image_id") % 3 == 0, F.array(F.lit(6), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(6)))
    rounds = Rounds(spark, new_folder(spark, "rounds"))
    rounds.start(ids.withColumn("is_screenshot", F.lit(True)), ids.select("image_id", modes.alias("psm_order")))
    return rounds, lambda tasks: tasks.join(scores, ["image_id", "variant", "psm"], "left").select("image_id", "variant", "psm", "score")


ROUND_CTES = """own AS (SELECT s.* EXCLUDE (psm_rank, phase), CASE WHEN (psm = 3) = (image_id % 3 <> 0) THEN 1 ELSE 2 END AS psm_rank,
    CASE WHEN variant >= 3 THEN '2' WHEN (psm = 3) = (image_id % 3 <> 0) THEN '1A' ELSE '1B' END AS phase FROM scores s),
  held AS (SELECT *, coalesce(max(score) FILTER (phase = '1A') OVER (PARTITION BY image_id), -1) AS a, coalesce(max(score) FILTER (phase <> '2') OVER (PARTITION BY image_id), -1) AS ab FROM own)"""


def rounds_sql(select: str) -> str:
    return sql("SELECT * FROM scores").replace("SELECT * FROM scores", f", {ROUND_CTES} {select}")


@query("c6_recognise_in_rounds", rounds_sql("""SELECT d.doc_id AS image_id, variant, psm, score, phase FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, phase, variant, psm_rank) AS place
  FROM held WHERE phase = '1A' OR (phase = '1B' AND a < 2400) OR (phase = '2' AND ab < 2400)) WHERE place = 1) b ON b.image_id = d.doc_id"""))
def c6(spark, d):
    return recognise_in_rounds(*rounds_over_scores(spark, d))


@query("c7_round_tasks", rounds_sql("""SELECT p.image_id, CAST(v AS INT) AS variant, CASE WHEN (r = 1) = (p.image_id % 3 = 0) THEN 6 ELSE 3 END AS psm, CASE WHEN v >= 3 THEN '2' WHEN r = 1 THEN '1A' ELSE '1B' END AS phase
  FROM (SELECT d.doc_id AS image_id, coalesce(max(a), -1) AS a, coalesce(max(ab), -1) AS ab FROM documents d LEFT JOIN held h ON h.image_id = d.doc_id GROUP BY d.doc_id) p, (SELECT unnest(range(0, 6)) AS v), (SELECT unnest([1, 2]) AS r)
  WHERE (v < 3 AND r = 1) OR (v < 3 AND r = 2 AND a < 2400) OR (v >= 3 AND ab < 2400)"""))
def c7(spark, d):
    rounds, recognise = rounds_over_scores(spark, d)
    asked = []
    for phase in C.PHASES:
        tasks = saved(rounds.tasks())
        asked.append(tasks.select("image_id", "variant", "psm", "phase"))
        rounds.merge(recognise(tasks), f"round-{phase}")
    return asked[0].unionByName(asked[1]).unionByName(asked[2])


# Text repair: the same lines through each function.
def dirty(f):
    return lambda spark, d: X.dirty_lines(spark, d).select("image_id", "line_no", f(F.col("line")).alias("fixed"))


def dirty_sql(expression: str) -> str:
    return sql(f"SELECT image_id, line_no, {expression} AS fixed FROM dirty_lines")


def replaces(c: str, rules) -> str:
    for old, new in rules:
        c = "replace({}, '{}', '{}')".format(c, old, new.replace("'", "''"))
    return c


def regexes(c: str, rules) -> str:
    for old, new in rules:
        c = f"regexp_replace({c}, '{old}', '{new}', 'g')"
    return c


T1_SQL = replaces("line", [*V.CURLY.items(), *V.LIGATURES.items()])
T2_SQL = regexes("line", [(r"([(\[=+\-*/, ])¡([+\-*/)0-9\]])", r"\1j\2"), (r"\bstr\(¡", "str(j"), (r"=¡\+", "=j+")])
T3_SQL = regexes("line", [(r"(_+)([a-záéíóúA-ZÁÉÍÓÚ])", r"\1 \2")])
STEMS = "|".join(V.SAFE_STEMS)


def radio_sql(c: str) -> str:
    s = trim(c)
    lead = f"regexp_extract({c}, '^\\s*') || '○ '"
    rest = f"substr({s}, 2)"
    return f"""CASE WHEN length({s}) <= 1 THEN {c}
      WHEN regexp_matches({s}, '^[©®™¢Øø]') THEN {lead} || ltrim({rest})
      WHEN NOT regexp_matches({s}, '^[Oo0]') THEN {c}
      WHEN {rest}[1] = ' ' THEN CASE WHEN regexp_matches({s}, '^O\\s+({STEMS})(\\s|$)') THEN {c} ELSE {lead} || ltrim({rest}) END
      WHEN regexp_matches({rest}, '^[.,:;]') THEN {lead} || {rest}
      WHEN {s}[1] = '0' AND regexp_matches({rest}, '^\\pL') THEN {lead} || {rest}
      WHEN regexp_matches({s}, '^O[{V.AFTER_BIG_O}]|^o[{V.AFTER_SMALL_O}]') THEN {c}
      WHEN regexp_matches({s}, '^[Oo]({STEMS})([^a-záéíóúñA-ZÁÉÍÓÚÑ]|$)') THEN {c}
      WHEN regexp_matches({rest}, '^\\pL') THEN {lead} || {rest} ELSE {c} END"""


T4_SQL = radio_sql("line")
T5_SQL = regexes("line", [(r"^\(\)\s*", "○ "), (r"^\[\]\s*", "☐ ")])
T6_SQL = regexes("line", [(r"\[[xXvV✓✔]\]\s*", "☑ ")])
T7_SQL = regexes("line", [(r"\s[¢©®™]\s", " ")])
T8_SQL = "repeat(' ', length(line) - length(ltrim(line, ' '))) || regexp_replace(ltrim(line, ' '), ' {3,}', ' ', 'g')"


def chained(*steps: str) -> str:
    """Steps over ``line``, each on the result of the one before."""
    inner = "SELECT image_id, line_no, line FROM dirty_lines"
    for step in steps:
        inner = f"SELECT image_id, line_no, {step} AS line FROM ({inner})"
    return sql(f"SELECT image_id, line_no, line AS fixed FROM ({inner})")


G_SQL = {
    "g1_fix_code_tokens": (T.fix_code_tokens, regexes("line", V.CODE_TOKENS)),
    "g2_fix_gender": (T.fix_gender, regexes("line", V.GENDER)),
    "g3_split_glued_words": (T.split_glued_words, regexes("line", V.GLUED)),
    "g4_fix_accents": (T.fix_accents, replaces("line", [(o.replace("\\b", ""), n) for o, n in V.ACCENTS])),
    "g6_shorten_runs": (T.shorten_runs, regexes("line", V.RUNS)),
}
G_SQL["g5_fix_digit_letters"] = (T.fix_digit_letters, "replace(replace(" + regexes("line", [(r"(\d)l(\d)", r"\1<1>\2"), (r"(\d)O(\d)", r"\1<0>\2")]) + ", '<1>', '1'), '<0>', '0')")
T_SQL = {
    "t1_fix_chars": (T.fix_chars, T1_SQL),
    "t2_fix_inverted_bang": (T.fix_inverted_bang, T2_SQL),
    "t3_split_underscores": (T.split_underscores, T3_SQL),
    "t4_split_radio_prefix": (T.split_radio_prefix, T4_SQL),
    "t5_fix_empty_brackets": (T.fix_empty_brackets, T5_SQL),
    "t6_fix_checked": (T.fix_checked, T6_SQL),
    "t7_drop_symbol_noise": (T.drop_symbol_noise, T7_SQL),
    "t8_collapse_spaces": (T.collapse_spaces, T8_SQL),
}
for _name, (_f, _s) in {**T_SQL, **G_SQL}.items():
    query(_name, dirty_sql(_s))(dirty(_f))
query("t9_fix_ocr_text", chained(T1_SQL, T2_SQL, T3_SQL, T4_SQL, T5_SQL, T6_SQL, T7_SQL, T8_SQL))(dirty(R.fix_ocr_text))

OWN_RULES = [("en", "EN", R.LITERAL, ("en",)), (r"(\w)\.(\w)", "$1. $2", R.REGEX, (".",)), ("ç", "z", R.LITERAL, ())]


@query("t10_rule_table", chained(T1_SQL, T2_SQL, T3_SQL, T4_SQL, T5_SQL, T6_SQL, T7_SQL, T8_SQL, replaces("line", [("en", "EN")]), regexes("line", [(r"([\p{L}\p{N}\p{M}\p{Pc}])\.([\p{L}\p{N}\p{M}\p{Pc}])", r"\1. \2")]), replaces("line", [("ç", "z")])))
def t10(spark, d):
    """The library's rules and three more, as rows of a table that is written and read."""
    own = [R.Rule(*x) for x in OWN_RULES]
    table = saved(spark.createDataFrame(R.rule_rows([*R.LINE_RULES, *own]), R.RULE_TABLE))
    return dirty(lambda line: R.fix_ocr_text(line, R.rules_of(table)))(spark, d)


G_STEPS = [s for _, s in G_SQL.values()]
NOISE_SQL = f"NOT (length({trim('line')}) BETWEEN 1 AND 2) OR regexp_matches({trim('line')}, '^[a-zA-Z0-9áéíóúñÁÉÍÓÚÑ]+$')"


def joined_sql(steps: list[str], keep: str = "true") -> str:
    inner = "SELECT image_id, line_no, line FROM dirty_lines"
    for step in steps:
        inner = f"SELECT image_id, line_no, {step} AS line FROM ({inner})"
    return sql(f"SELECT image_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER ({keep}), '') AS text FROM ({inner}) GROUP BY image_id")


def joined_lines(lines: DataFrame) -> DataFrame:
    """image_id, text of lines put together again."""
    return lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("g7_drop_noise_lines", joined_sql([], NOISE_SQL))
def g7(spark, d):
    return joined_lines(X.dirty_lines(spark, d)).select("image_id", T.drop_noise_lines(F.col("text")).alias("text"))


@query("g8_apply_global_fixes", joined_sql(G_STEPS, NOISE_SQL))
def g8(spark, d):
    return joined_lines(X.dirty_lines(spark, d)).select("image_id", R.apply_global_fixes(F.col("text")).alias("text"))


# Questions.
@query("e1_mark_question_heads", sql("SELECT image_id, line_no, s FROM marked WHERE is_head"))
def e1(spark, d):
    return E.mark_lines(X.exam_lines(spark, d)).where("is_head").select("image_id", "line_no", "s")


@query("e2_count_option_lines", sql("SELECT image_id, count(*) FILTER (is_option) AS n_options FROM marked GROUP BY image_id"))
def e2(spark, d):
    return E.mark_lines(X.exam_lines(spark, d)).groupBy("image_id").agg(F.count_if("is_option").alias("n_options"))


@query("e3_classify_document", sql("""SELECT image_id, n_heads, n_options, CASE WHEN n_heads < 2 AND n_options < 4 THEN 'plain' WHEN n_heads = 0 THEN 'options' ELSE 'exam' END AS route
  FROM (SELECT image_id, count(*) FILTER (is_head) AS n_heads, count(*) FILTER (is_option) AS n_options FROM marked GROUP BY image_id)"""))
def e3(spark, d):
    return E.classify_documents(X.exam_lines(spark, d))


OPTION_SQL = f"CASE WHEN regexp_matches({trim('line')}, '^[○☐☑]\\s') THEN line WHEN regexp_matches({trim('line')}, '^[a-dA-D][).]\\s+(.+)') THEN '○ ' || regexp_extract({trim('line')}, '^[a-dA-D][).]\\s+(.+)', 1) ELSE {T4_SQL} END"


@query("e4_normalize_option_lines", sql(f"SELECT image_id, line_no, {OPTION_SQL} AS fixed FROM exam_lines"))
def e4(spark, d):
    return X.exam_lines(spark, d).select("image_id", "line_no", T.normalize_option_line(F.col("line")).alias("fixed"))


@query("e5_segment_questions", sql("SELECT image_id, line_no, CAST(q_no AS BIGINT) AS q_no FROM segs"))
def e5(spark, d):
    return E.segment_questions(E.mark_lines(X.exam_lines(spark, d))).select("image_id", "line_no", "q_no")


@query("e6_statement_end", sql("SELECT image_id, CAST(q_no AS BIGINT) AS q_no, max(rest_start) AS rest_start, max(j) + 1 AS n_body FROM ends GROUP BY image_id, q_no"))
def e6(spark, d):
    return E.statement_ends(E.question_bodies(E.segment_questions(E.mark_lines(X.exam_lines(spark, d))))).groupBy("image_id", "q_no").agg(F.max("rest_start").alias("rest_start"), (F.max("j") + 1).alias("n_body"))


@query("e7_is_code_line", sql(f"SELECT image_id, line_no FROM marked WHERE {CODE_SQL}"))
def e7(spark, d):
    return X.exam_lines(spark, d).where(T.is_code_line(T.strip(F.col("line")))).select("image_id", "line_no")


@query("e8_split_code_options", sql("SELECT image_id, CAST(q_no AS BIGINT) AS q_no, j, part FROM parts"))
def e8(spark, d):
    return E.split_code_options(E.statement_ends(E.question_bodies(E.segment_questions(E.mark_lines(X.exam_lines(spark, d)))))).select("image_id", "q_no", "j", "part")


LISTS = ", ".join(f"coalesce((SELECT string_agg({v}, '|' ORDER BY j) FROM parts p WHERE p.image_id = h.image_id AND p.q_no = h.q_no AND part = '{k}'), '') AS {n}" for k, v, n in (("statement", "line", "statement"), ("code", "line", "code"), ("option", "s", "options")))


@query("e8b_extract_questions", sql(f"SELECT h.image_id, CAST(h.q_no AS BIGINT) AS q_no, h.s AS header, {LISTS} FROM segs h WHERE h.is_head"))
def e8b(spark, d):
    return E.extract_questions(X.exam_lines(spark, d)).select("image_id", "q_no", "header", *[F.concat_ws("|", c).alias(c) for c in ("statement", "code", "options")])


def clean_sql(c: str) -> str:
    a = regexes(c, [(r"^[○☐☑]\s*", "")])
    b = f"CASE WHEN regexp_matches(t0, '^[Oo0][a-záéíóúñ\\\\.].*$') AND NOT regexp_matches(t0, '^O[{V.AFTER_BIG_O}]|^o[{V.AFTER_SMALL_O}]') AND NOT regexp_matches(t0, '^[Oo]({STEMS})([^a-záéíóúñA-ZÁÉÍÓÚÑ]|$)') THEN substr(t0, 2) ELSE t0 END"
    e = regexes("t1", [(r"^[Oo0]\s+", ""), (r"^[a-dA-D][).]\s*", ""), (r"^[Oo0][).]\s*", ""), (r"^[©®™¢Øø]\s*", ""), (r"^\(\)\s*", ""), (r"^\[\]\s*", ""), (r"^[\-–—]\s+", "")])
    return f"SELECT image_id, line_no, {trim(e)} AS fixed FROM (SELECT *, {b} AS t1 FROM (SELECT *, {a} AS t0 FROM dirty_lines))"


@query("e8c_clean_option_text", sql(clean_sql(trim("line"))))
def e8c(spark, d):
    return X.dirty_lines(spark, d).select("image_id", "line_no", T.clean_option_text(T.strip(F.col("line"))).alias("fixed"))


def rebuilt_ctes() -> str:
    """Cleaned options, question blocks and the rebuilt text of every page with questions."""
    step1 = regexes("s", [(r"^[○☐☑]\s*", "")])
    joined = f"regexp_matches(t0, '^[Oo0][a-záéíóúñ\\\\.].*$') AND NOT regexp_matches(t0, '^O[{V.AFTER_BIG_O}]|^o[{V.AFTER_SMALL_O}]') AND NOT regexp_matches(t0, '^[Oo]({STEMS})([^a-záéíóúñA-ZÁÉÍÓÚÑ]|$)')"
    rest = regexes("t1", [(r"^[Oo0]\s+", ""), (r"^[a-dA-D][).]\s*", ""), (r"^[Oo0][).]\s*", ""), (r"^[©®™¢Øø]\s*", ""), (r"^\(\)\s*", ""), (r"^\[\]\s*", ""), (r"^[\-–—]\s+", "")])
    return f"""opts AS (SELECT image_id, q_no, string_agg('○ ' || o, chr(10) ORDER BY j) FILTER (o <> '') AS options FROM (
        SELECT image_id, q_no, j, {trim(rest)} AS o FROM (SELECT *, CASE WHEN {joined} THEN substr(t0, 2) ELSE t0 END AS t1 FROM (SELECT *, {step1} AS t0 FROM parts WHERE part = 'option'))) GROUP BY image_id, q_no),
      body AS (SELECT image_id, q_no, string_agg(line, chr(10) ORDER BY j) FILTER (part = 'statement') AS statement, string_agg(line, chr(10) ORDER BY j) FILTER (part = 'code') AS code FROM parts GROUP BY image_id, q_no),
      qs AS (SELECT h.image_id, h.q_no, code IS NOT NULL AND options IS NULL AS ends_blank,
          repeat('─', 50) || chr(10) || chr(10) || h.s || coalesce(chr(10) || statement, '') || coalesce(chr(10) || chr(10) || code || chr(10), '') || coalesce(chr(10) || options, '') AS block
        FROM segs h LEFT JOIN body b ON h.image_id = b.image_id AND h.q_no = b.q_no LEFT JOIN opts o ON h.image_id = o.image_id AND h.q_no = o.q_no WHERE h.is_head),
      pre AS (SELECT image_id, 0 AS q_no, arg_max(s, line_no) = '' AS ends_blank, string_agg(line, chr(10) ORDER BY line_no) AS block FROM segs WHERE q_no = 0 AND image_id IN (SELECT image_id FROM qs) GROUP BY image_id),
      every AS (SELECT *, lag(ends_blank) OVER (PARTITION BY image_id ORDER BY q_no) AS after_blank FROM (SELECT * FROM qs UNION ALL SELECT * FROM pre)),
      rebuilt AS (SELECT image_id, string_agg(CASE WHEN after_blank IS NULL THEN '' WHEN after_blank THEN chr(10) ELSE chr(10) || chr(10) END || block, '' ORDER BY q_no) AS text FROM every GROUP BY image_id)"""


def with_rebuilt(body: str) -> str:
    return sql("SELECT 1 FROM parts, segs").replace("SELECT 1 FROM parts, segs", f", {rebuilt_ctes()} {body}")


@query("e8d_rebuild_exam_text", with_rebuilt("SELECT image_id, text FROM rebuilt"))
def e8d(spark, d):
    lines = X.exam_lines(spark, d)
    return E.rebuild_exam_text(lines, E.extract_questions(lines))


def routed_ctes(lines: str) -> str:
    """Repaired texts by route (``routed``), from the lines in ``lines`` and what ``rebuilt_ctes`` has."""
    first = f"""routes AS (SELECT image_id, CASE WHEN h < 2 AND o < 4 THEN 'plain' WHEN h = 0 THEN 'options' ELSE 'exam' END AS route FROM (SELECT image_id, count(*) FILTER (is_head) AS h, count(*) FILTER (is_option) AS o FROM marked GROUP BY image_id)),
      before AS (SELECT image_id, route, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM rebuilt JOIN routes USING (image_id) WHERE route = 'exam'
        UNION ALL SELECT m.image_id, route, line_no, CASE WHEN route = 'options' THEN {OPTION_SQL} ELSE line END FROM {lines} m JOIN routes USING (image_id) WHERE route <> 'exam')"""
    inner = "SELECT * FROM before"
    for step in G_STEPS:
        inner = f"SELECT image_id, route, line_no, {step} AS line FROM ({inner})"
    joined = f"SELECT image_id, route, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER ({NOISE_SQL}), '') AS text FROM ({inner}) GROUP BY image_id, route"
    return f"{first}, routed AS (SELECT image_id, route, CASE WHEN route = 'exam' THEN regexp_replace(text, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') ELSE text END AS text FROM ({joined}))"


def routed_sql() -> str:
    return with_rebuilt(f", {routed_ctes('exam_lines')} SELECT image_id, route, text FROM routed")


T9_STEPS = [T1_SQL, T2_SQL, T3_SQL, T4_SQL, T5_SQL, T6_SQL, T7_SQL, T8_SQL]
LAID_OUT = "gaps usual plines_raw plines blocks placed reading formatted texts counts page_lines marked segs bodies ends coded parts0 parts".split()


def documents_sql(first: dict[str, str]) -> str:
    """Pages from word rows to repaired texts; ``first`` ends with the definition of ``words``."""
    inner = "SELECT *, text AS line FROM plines_raw"
    for step in T9_STEPS:
        inner = f"SELECT * EXCLUDE (line), {step} AS line FROM ({inner})"
    own = first | {k: CTES.get(k, "") for k in LAID_OUT}
    own |= {
        "plines_raw": CTES["plines"],
        "plines": f"SELECT * EXCLUDE (text, line), line AS text FROM ({inner})",
        "page_lines": "SELECT image_id, generate_subscripts(string_split(formatted_text, chr(10)), 1) - 1 AS line_no, unnest(string_split(formatted_text, chr(10))) AS line FROM texts",
        "marked": CTES["marked"].replace("exam_lines", "page_lines"),
    }
    body = ", ".join(f"{k} AS ({v})" for k, v in own.items())
    select = """SELECT d.doc_id AS image_id, coalesce(column_count, 1) AS column_count, coalesce(column_count, 1) > 1 AS is_multicolumn, coalesce(n_blocks, 0) AS n_blocks, coalesce(word_count, 0) AS word_count, avg_confidence,
      image_width, image_height, CASE WHEN t.image_id IS NOT NULL THEN 'spa' END AS language, coalesce(r.text, '[Sin texto detectado]') AS formatted_text
      FROM documents d LEFT JOIN texts t ON d.doc_id = t.image_id LEFT JOIN counts c ON t.image_id = c.image_id LEFT JOIN routed r ON t.image_id = r.image_id"""
    return X.duck(f", {body}, {rebuilt_ctes()}, {routed_ctes('page_lines')} {select}")


def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("image_id"))


def document_rows(docs: DataFrame) -> DataFrame:
    return docs.select("image_id", "column_count", (F.col("column_count") > 1).alias("is_multicolumn"), "n_blocks", "word_count", "avg_confidence", "image_width", "image_height", "language", "formatted_text")


@query("l9_reconstruct", documents_sql({"words": CTES["words"]}))
def l9(spark, d):
    return document_rows(lay_out(X.ocr_words(spark, d), MIN_CONF, pages=page_ids(spark, d), dealt=True).docs)


@query("e9_post_process_document", routed_sql())
def e9(spark, d):
    return E.post_process_documents(joined_lines(X.exam_lines(spark, d)))


# Images.
PIX = """SELECT vec_id AS image_id, i - 1 AS i, CASE WHEN hi > lo THEN CAST(floor((e - lo) / (hi - lo) * 255) AS BIGINT) ELSE 128 END AS v FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)"""
LAP = """SELECT image_id, (64 * sum(e * e) - sum(e) * sum(e))::DOUBLE / 4096 AS laplacian_var FROM (SELECT c.image_id, u.v + d.v + l.v + r.v - 4 * c.v AS e FROM pix c
  JOIN pix u ON u.image_id = c.image_id AND u.i = c.i + CASE WHEN c.i < 8 THEN 8 ELSE -8 END
  JOIN pix d ON d.image_id = c.image_id AND d.i = c.i + CASE WHEN c.i >= 56 THEN -8 ELSE 8 END
  JOIN pix l ON l.image_id = c.image_id AND l.i = c.i + CASE WHEN c.i % 8 = 0 THEN 1 ELSE -1 END
  JOIN pix r ON r.image_id = c.image_id AND r.i = c.i + CASE WHEN c.i % 8 = 7 THEN -1 ELSE 1 END) GROUP BY image_id"""
ENT = "SELECT image_id, -sum(n / 64.0 * log2(n / 64.0)) AS entropy FROM (SELECT image_id, v, count(*) AS n FROM pix GROUP BY image_id, v) GROUP BY image_id"
STD = "SELECT image_id, stddev_pop(v) AS contrast FROM pix GROUP BY image_id"
FEAT = f"pix AS ({PIX}), lap AS ({LAP}), ent AS ({ENT}), std AS ({STD}), feat AS (SELECT lap.image_id, laplacian_var, entropy, contrast, laplacian_var > 300 AND entropy < 6.8 AS ss FROM lap JOIN ent ON lap.image_id = ent.image_id JOIN std ON lap.image_id = std.image_id)"
#: Large images: 12 x 12 squares of one value, each 25 x 25 pixels in 300 x 300. The second differences of a square are
#: those to its neighbours on its edge rows and columns, and both in its corners.
CELL_PIX = f"""SELECT image_id, k.i, v FROM (SELECT image_id, max(i) + 1 AS n FROM (SELECT image_id // 3 AS image_id, (image_id % 3) * 64 + i AS i FROM ({PIX})) GROUP BY image_id) s, (SELECT unnest(range(144)) AS i) k
  JOIN (SELECT image_id // 3 AS of, (image_id % 3) * 64 + i AS at, v FROM ({PIX})) p ON p.of = s.image_id AND p.at = k.i % s.n"""
CELL_LAP = """SELECT image_id, (90000 * sum(e2) - sum(e) * sum(e))::DOUBLE / 8100000000 AS laplacian_var FROM (
  SELECT image_id, 25 * (u + d + l + r) AS e, 25 * (u * u + d * d + l * l + r * r) + 2 * (u + d) * (l + r) AS e2 FROM (
    SELECT c.image_id, coalesce(a.v - c.v, 0) AS u, coalesce(b.v - c.v, 0) AS d, coalesce(f.v - c.v, 0) AS l, coalesce(g.v - c.v, 0) AS r FROM pix c
    LEFT JOIN pix a ON a.image_id = c.image_id AND a.i = c.i - 12 LEFT JOIN pix b ON b.image_id = c.image_id AND b.i = c.i + 12
    LEFT JOIN pix f ON f.image_id = c.image_id AND f.i = c.i - 1 AND c.i % 12 > 0 LEFT JOIN pix g ON g.image_id = c.image_id AND g.i = c.i + 1 AND c.i % 12 < 11)) GROUP BY image_id"""
CELL_FEAT = FEAT.replace(PIX, CELL_PIX).replace(LAP, CELL_LAP).replace("64.0", "144.0")
TIER = "CASE WHEN ss AND laplacian_var > 500 THEN 'alta' WHEN (laplacian_var > 100 AND contrast > 30) OR (ss AND laplacian_var > 200) THEN 'media' ELSE 'baja' END"


def features(spark, d) -> DataFrame:
    return I.pixel_features(X.images(spark, d), resize=False)


@query("i1_pixel_features", f"WITH {FEAT} SELECT f.image_id, 8 AS height, 8 AS width, round(laplacian_var, 6) AS laplacian_var, (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT v, count(*) AS n FROM pix p WHERE p.image_id = f.image_id GROUP BY v)) AS hist FROM feat f")
def i1(spark, d):
    return listed_features(features(spark, d), "hist")


def listed_features(found: DataFrame, *hists: str) -> DataFrame:
    """Sizes, rounded sharpness, and the filled bins of histograms as text."""
    bins = lambda h: F.filter(F.transform(h, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"] > 0)
    text = lambda h: F.array_join(F.transform(bins(h), lambda x: F.concat_ws(":", x["i"].cast("string"), x["n"].cast("string"))), ",").alias(h)
    return found.select("image_id", "height", "width", F.round("laplacian_var", 6).alias("laplacian_var"), *map(text, hists))


@query("i1_reduced_features", f"""WITH {CELL_FEAT} SELECT f.image_id, 720 + CAST(f.image_id % 2 * 120 AS INT) AS height, 720 AS width, round(laplacian_var, 6) AS laplacian_var,
  (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT v, count(*) * 625 AS n FROM pix p WHERE p.image_id = f.image_id GROUP BY v)) AS hist, (SELECT string_agg(v || ':' || n, ',' ORDER BY v) FROM (SELECT v, count(*) * 2500 AS n FROM pix p WHERE p.image_id = f.image_id GROUP BY v)) AS layout_hist FROM feat f""")
def i1_reduced(spark, d):
    return listed_features(I.pixel_features(X.large_images(spark, d)), "hist", "layout_hist")


@query("i2_entropy", f"WITH {FEAT} SELECT image_id, round(entropy, 6) AS entropy FROM feat")
def i2(spark, d):
    return features(spark, d).select("image_id", F.round(I.entropy(F.col("hist")), 6).alias("entropy"))


@query("i3_contrast", f"WITH {FEAT} SELECT image_id, round(contrast, 6) AS contrast FROM feat")
def i3(spark, d):
    return features(spark, d).select("image_id", F.round(I.contrast(F.col("hist")), 6).alias("contrast"))


@query("i4_is_screenshot", f"WITH {FEAT} SELECT image_id, ss AS is_screenshot FROM feat")
def i4(spark, d):
    return features(spark, d).select("image_id", I.is_screenshot(F.col("laplacian_var"), I.entropy(F.col("hist"))).alias("is_screenshot"))


@query("i5_quality_tier", f"WITH {FEAT} SELECT image_id, {TIER} AS quality_tier FROM feat")
def i5(spark, d):
    return I.image_quality(features(spark, d)).select("image_id", "quality_tier")


@query("i6_suggested_confidence", """SELECT image_id, CASE WHEN m < 300 THEN 3.0::DOUBLE WHEN m < 600 THEN least(b, 5) ELSE b END AS suggested_confidence
  FROM (SELECT p_partkey AS image_id, least(200 + p_partkey % 4000, 150 + p_size * 60) AS m, (CASE p_partkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 3 END)::DOUBLE AS b FROM part)""")
def i6(spark, d):
    tier = F.when(F.col("image_id") % 3 == 0, "alta").when(F.col("image_id") % 3 == 1, "media").otherwise("baja")
    return X.image_sizes(spark, d).select("image_id", I.suggested_confidence(tier, F.least("width", "height")).alias("suggested_confidence"))


@query("i7_image_quality", f"WITH {FEAT} SELECT image_id, ss AS is_screenshot, 8 AS width, 8 AS height, 64::BIGINT AS total_pixels, 8 AS min_dimension, 3.0::DOUBLE AS suggested_confidence, {TIER} AS quality_tier, {half_even('laplacian_var', 1)} AS sharpness, {half_even('entropy', 2)} AS entropy, {half_even('contrast', 1)} AS contrast FROM feat")
def i7(spark, d):
    return I.image_quality(features(spark, d))


@query("i8_upscale_plan", sql("""SELECT image_id, scale, CAST(floor(height * scale) AS INT) AS new_height, CAST(floor(width * scale) AS INT) AS new_width, CAST(floor(height * scale) AS INT) + 160 AS padded_height, CAST(floor(width * scale) AS INT) + 160 AS padded_width
  FROM (SELECT *, CASE WHEN height::DOUBLE * width * s * s > 30000000 THEN greatest(1.5::DOUBLE, least(s, sqrt(30000000 / (height::DOUBLE * width)))) ELSE s END AS scale
    FROM (SELECT *, least(greatest(2200 / least(height, width)::DOUBLE, 1.5), 4.0)::DOUBLE AS s FROM image_sizes))"""))
def i8(spark, d):
    return I.upscale_plan(X.image_sizes(spark, d))


@query("i9_otsu_density", f"""WITH pix AS ({PIX}), b AS (SELECT image_id, t, (SELECT count(*) FROM pix p WHERE p.image_id = k.image_id AND p.v <= t) AS n0, (SELECT sum(v) FROM pix p WHERE p.image_id = k.image_id AND p.v <= t) AS s0,
    (SELECT sum(v) FROM pix p WHERE p.image_id = k.image_id) AS s FROM (SELECT DISTINCT image_id, v AS t FROM pix) k),
  o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n0 * (64 - n0) * power(s0 / n0 - (s - s0) / (64 - n0)::DOUBLE, 2) DESC, t) AS place FROM b WHERE n0 < 64)
  SELECT image_id, CAST(t AS INT) AS threshold, n0 / 64.0::DOUBLE AS text_density FROM o WHERE place = 1""")
def i9(spark, d):
    return features(spark, d).withColumn("threshold", I.otsu(F.col("layout_hist"))).select("image_id", "threshold", I.text_density(F.col("layout_hist"), F.col("threshold")).alias("text_density"))


@query("i10_segment_stats", sql("""SELECT image_id, round(skew, 9) AS skew, h_lines, abs(skew) BETWEEN 0.3 AND 10 AS turn FROM (
  SELECT image_id, coalesce(median(a) FILTER (purpose = 'skew' AND abs(a) < 15), 0) AS skew, count(*) FILTER (purpose = 'layout' AND abs(a) < 5) AS h_lines
  FROM (SELECT *, degrees(atan2(y2 - y1, x2 - x1)) AS a FROM segments) GROUP BY image_id)"""))
def i10(spark, d):
    return I.segment_stats(X.segments(spark, d)).withColumn("skew", F.round("skew", 9))


@query("i11_block_count", sql("""SELECT s.image_id, count(*) FILTER (area > least(height, 600) * least(width, 600) * 0.0005) AS n_blocks FROM image_sizes s LEFT JOIN contours c ON c.image_id = s.image_id GROUP BY s.image_id"""))
def i11(spark, d):
    return I.block_count(X.contours(spark, d), X.image_sizes(spark, d))


@query("i12_rank_psm", sql("""SELECT image_id, s3 AS score_3, s6 AS score_6, CASE WHEN s6 > s3 THEN '6,3' ELSE '3,6' END AS psm_order FROM (
  SELECT image_id, (CASE WHEN a <= 1 THEN 2 ELSE 0 END) + (CASE WHEN hl >= 5 THEN 1 ELSE 0 END) + (CASE WHEN td > 0.08 AND td <= 0.15 THEN 1 ELSE 0 END) + (CASE WHEN nb < 5 THEN 1 ELSE 0 END) AS s3,
    (CASE WHEN a > 2 THEN 3 WHEN a > 1 THEN 2 ELSE 0 END) + (CASE WHEN hl >= 5 THEN 2 ELSE 0 END) + (CASE WHEN td > 0.15 THEN 2 WHEN td > 0.08 THEN 1 ELSE 0 END) + (CASE WHEN nb > 20 THEN 1 ELSE 0 END) AS s6
  FROM (SELECT image_id, height::DOUBLE / greatest(width, 1) AS a, image_id % 9 AS hl, (image_id % 23) / 100.0 AS td, image_id % 27 AS nb FROM image_sizes))"""))
def i12(spark, d):
    f = X.image_sizes(spark, d).withColumns({"h_lines": F.col("image_id") % 9, "text_density": (F.col("image_id") % 23) / 100, "n_blocks": F.col("image_id") % 27})
    return I.rank_psm(f).select("image_id", "score_3", "score_6", F.concat_ws(",", F.transform("psm_order", lambda x: x.cast("string"))).alias("psm_order"))


# Sources and sinks.
TXT_SQL = """SELECT t.image_id, repeat('=', 60) || chr(10) || 'TEXTO EXTRAÍDO POR OCR' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'Idioma: spa' || chr(10) || 'Palabras detectadas: ' || word_count || chr(10)
  || 'Confianza promedio: ' || printf('%.1f', avg_confidence) || '%' || chr(10) || 'Bloques: ' || n_blocks || chr(10) || 'Columnas: ' || CAST(column_count AS BIGINT) || chr(10) || chr(10) || repeat('-', 60) || chr(10) || chr(10) || formatted_text || chr(10) || chr(10) || repeat('-', 60) || chr(10) || 'Fin del documento' AS content
  FROM texts t JOIN counts c ON t.image_id = c.image_id"""
PARAGRAPHS_SQL = """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY sec, a, b) - 1 AS INT) AS ord, kind, paragraph FROM (
    SELECT image_id, 0 AS sec, 0 AS a, 0 AS b, 'title' AS kind, 'Texto Extraído por OCR' AS paragraph FROM texts
    UNION ALL SELECT t.image_id, 1, k, 0, 'meta', CASE k WHEN 1 THEN 'Idioma: spa' WHEN 2 THEN 'Palabras: ' || word_count WHEN 3 THEN 'Confianza: ' || printf('%.1f', avg_confidence) || '%' WHEN 4 THEN 'Bloques: ' || n_blocks ELSE 'Columnas: ' || CAST(column_count AS BIGINT) END
      FROM texts t JOIN counts c ON t.image_id = c.image_id, (SELECT unnest(range(1, 6)) AS k)
    UNION ALL SELECT image_id, k, 0, 0, 'rule', repeat('─', 50) FROM texts, (SELECT unnest([2, 4]) AS k)
    UNION ALL SELECT l.image_id, 3, read_ord, line_ord, 'line', text FROM plines l JOIN reading r ON l.image_id = r.image_id AND l.block_num = r.block_num
    UNION ALL SELECT image_id, 3, read_ord, 1000000, 'blank', '' FROM (SELECT *, max(read_ord) OVER (PARTITION BY image_id) AS n FROM reading) WHERE read_ord < n
    UNION ALL SELECT image_id, 5, 0, 0, 'footer', 'Documento generado' FROM texts)"""
EXPORTED = datetime(2026, 3, 1, 14, 30, 25)
NAME_SQL = "'scan' || (image_id // 2) || '_2026-03-01_14-30-25' || CASE WHEN row_number() OVER (PARTITION BY image_id // 2 ORDER BY image_id) > 1 THEN '_' || image_id ELSE '' END"
FILES_SQL = f"""SELECT 'txt' AS kind, {NAME_SQL} || '.txt' AS name, chr(65279) || content AS content FROM ({TXT_SQL})
  UNION ALL SELECT 'json', {NAME_SQL} || '.json', formatted_text FROM texts
  UNION ALL SELECT 'docx', {NAME_SQL} || '.docx', content FROM (SELECT image_id, string_agg(paragraph || chr(10), '' ORDER BY ord) AS content FROM ({PARAGRAPHS_SQL}) GROUP BY image_id)"""
@query("s1_read_images", "SELECT page_id, url FROM (SELECT page_id, url || (CASE page_id % 9 WHEN 0 THEN '.JPG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.webp' WHEN 4 THEN '.tiff' WHEN 5 THEN '.TIF' WHEN 6 THEN '.bmp' WHEN 7 THEN '.gif' ELSE '.png.txt' END) AS url FROM pages) WHERE page_id % 9 < 7")
def s1(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".JPG", ".jpeg", ".png", ".webp", ".tiff", ".TIF", ".bmp", ".gif", ".png.txt")]), (F.col("page_id") % 9 + 1).cast("int"))
    named = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat("url", ends).alias("url"))
    return named.where(S.accepted_suffix(F.col("url")))


@query("s2_read_ocr_words", sql("""SELECT image_id, ord, nullif(replace(text, chr(9), ' '), '') AS text, conf, "left", top, width, height, line_num, word_num FROM ocr_words"""))
def s2(spark, d):
    words = X.ocr_words(spark, d).withColumn("text", F.translate("text", "\t", " "))  # a tab ends a field of such tables
    names = [c.split()[0] for c in S.WORD_SCHEMA.split(", ")]
    rows = words.select(F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in names]).alias("value"))
    return S.parse_word_rows(rows).select("image_id", "ord", "text", "conf", "left", "top", "width", "height", "line_num", "word_num")


@query("s1_image_files", f"""WITH pix AS ({PIX}) SELECT image_id, CASE image_id % 11 WHEN 3 THEN 'suffix' WHEN 5 THEN 'empty' WHEN 7 THEN 'broken' END AS reason,
  CASE WHEN image_id % 11 NOT IN (3, 5, 7) THEN 8 END AS height, CASE WHEN image_id % 11 NOT IN (3, 5, 7) THEN 8 END AS width, CASE WHEN image_id % 11 NOT IN (3, 5, 7) THEN string_agg(printf('%02X', v), '' ORDER BY i) END AS pixels
  FROM pix GROUP BY image_id""")
def s1_files(spark, d):
    folder = new_folder(spark, "images")
    write_files(X.image_files(spark, d), folder)
    every = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substr(F.hex("image.data"), i * 6 + 1, F.lit(2)))
    good, bad = S.read_images(spark, folder)
    page = S.page_of_file(F.col("path")).alias("image_id")
    found = good.select(page, F.lit(None).cast("string").alias("reason"), "image.height", "image.width", F.array_join(every, "").alias("pixels"))
    return found.unionByName(bad.select(page, "reason"), allowMissingColumns=True)


@query("s2_word_files", sql("""SELECT image_id, ord, CASE ord % 97 WHEN 5 THEN 'malformed' WHEN 7 THEN 'missing conf' END AS reason, CASE WHEN ord % 97 NOT IN (5, 7) THEN replace(text, chr(9), ' ') END AS text, CASE WHEN ord % 97 NOT IN (5, 7) THEN conf END AS conf,
  CASE WHEN ord % 97 NOT IN (5, 7) THEN "left" END AS "left", CASE WHEN ord % 97 NOT IN (5, 7) THEN word_num END AS word_num FROM ocr_words"""))
def s2_files(spark, d):
    folder, row = new_folder(spark, "words"), F.col("ord") % 97
    conf = F.when(row == 5, "x").when(row != 7, F.col("conf").cast("string"))
    words = X.ocr_words(spark, d).withColumn("text", F.translate("text", "\t", " ")).withColumn("conf", conf)
    S.write_ocr_words(words.select(*[c.split()[0] for c in S.WORD_SCHEMA.split(", ")]), folder)
    good, bad = S.split_ocr_words(spark, folder)
    cells = F.split("line", "\t", -1)
    lost = bad.select(cells[0].cast("long").alias("image_id"), cells[6].cast("long").alias("ord"), "reason")
    return good.select("image_id", "ord", F.lit(None).cast("string").alias("reason"), "text", "conf", "left", "word_num").unionByName(lost, allowMissingColumns=True)


@query("s5_export_files", sql(FILES_SQL))
def s5_files(spark, d):
    p = pages(spark, d, keep_words=True)
    folder = new_folder(spark, "exports")
    docs = p.docs.withColumn("path", F.concat(F.lit("/in/"), F.col("image_id") % 2, F.lit("/scan"), F.floor(F.col("image_id") / 2), F.lit(".png")))
    S.export(docs, p.placed, "all", folder, EXPORTED, one_file_each=True)
    files = [read_files(spark, f"{folder}/{kind}").select(F.lit(kind).alias("kind"), "name", F.col("content").cast("string").alias("content")) for kind in ("txt", "json", "docx")]
    files[1] = files[1].withColumn("content", F.get_json_object("content", "$.texto_completo"))
    return files[0].unionByName(files[1]).unionByName(files[2])


@query("s5_export_sinks", """SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['txt'] WHEN 1 THEN ['json'] WHEN 2 THEN ['docx'] WHEN 3 THEN ['txt', 'json', 'docx'] ELSE [] END) AS sink FROM documents""")
def s5(spark, d):
    asked = F.element_at(F.array(*[F.lit(x) for x in (" TXT", "json ", "Docx", " ALL ", "pdf")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(S.sinks_of(asked)).alias("sink"))


@query("s3_txt_content", sql(TXT_SQL))
def s3(spark, d):
    return S.txt_content(pages(spark, d).docs)


@query("s4_json_struct", sql("""SELECT t.image_id, word_count AS total_palabras, CAST(column_count AS BIGINT) AS total_columnas, n_blocks AS total_bloques, image_width || 'x' || image_height AS dimensiones, column_count > 1 AS es_multicolumna, formatted_text AS texto_completo,
    (SELECT string_agg(r.block_num || ':' || r.x || ',' || r.y || ',' || r.width || ',' || r.height, '|' ORDER BY read_ord) FROM reading r WHERE r.image_id = t.image_id) AS bloques,
    (SELECT string_agg(l.x || ',' || l.y || ',' || l.width || ',' || l.height || ':' || text, '|' ORDER BY read_ord, line_ord) FROM plines l JOIN reading r ON l.image_id = r.image_id AND l.block_num = r.block_num WHERE l.image_id = t.image_id) AS lineas,
    (SELECT string_agg(text || ':' || CAST(conf AS BIGINT) || ':' || "left" || ',' || top || ',' || width || ',' || height, '|' ORDER BY read_ord, line_ord, "left", ord) FROM (
      SELECT w.*, read_ord, line_ord FROM words w JOIN plines l ON w.image_id = l.image_id AND w.block_num = l.block_num AND w.line_key = l.line_key JOIN reading r ON w.image_id = r.image_id AND w.block_num = r.block_num WHERE w.image_id = t.image_id)) AS palabras,
    (SELECT string_agg(column_id || ':' || x_start || '-' || x_end || ':' || ids, '|' ORDER BY column_id) FROM (
      SELECT column_id, min(x) AS x_start, max(x + width) AS x_end, string_agg(block_num::VARCHAR, ',' ORDER BY cx, block_ord) AS ids FROM placed p WHERE p.image_id = t.image_id GROUP BY column_id)) AS columnas
    FROM texts t JOIN counts c ON t.image_id = c.image_id"""))
def s4(spark, d):
    p = pages(spark, d, keep_words=True)
    tree = S.json_struct(p.docs, p.placed, include_words=True)
    text = tree.select("image_id", F.to_json(F.struct("metadata", "texto_completo", "bloques", "columnas"), {"ignoreNullFields": "false"}).alias("j"))
    box = "coordenadas:array<int>"
    got = F.from_json(
        "j",
        "metadata struct<total_palabras:bigint,total_columnas:bigint,total_bloques:bigint,es_multicolumna:boolean,dimensiones_imagen:struct<ancho:int,alto:int>>, texto_completo string, "
        f"bloques array<struct<bloque_num:int,{box},lineas:array<struct<texto:string,{box},palabras:array<struct<texto:string,confianza:double,{box}>>>>>>, columnas array<struct<columna_id:bigint,x_inicio:int,x_fin:int,bloques_ids:array<int>>>",
    )
    nums = lambda a: F.concat_ws(",", F.transform(a, lambda n: n.cast("string")))
    listed = lambda a, f: F.array_join(F.transform(a, f), "|")
    lineas = F.flatten(F.transform("j.bloques", lambda b: b["lineas"]))
    m = "j.metadata"
    return text.select("image_id", got.alias("j")).select(
        "image_id", f"{m}.total_palabras", f"{m}.total_columnas", f"{m}.total_bloques", F.concat_ws("x", f"{m}.dimensiones_imagen.ancho", f"{m}.dimensiones_imagen.alto").alias("dimensiones"), f"{m}.es_multicolumna", "j.texto_completo",
        listed("j.bloques", lambda b: F.concat_ws(":", b["bloque_num"].cast("string"), nums(b["coordenadas"]))).alias("bloques"),
        listed(lineas, lambda x: F.concat_ws(":", nums(x["coordenadas"]), x["texto"])).alias("lineas"),
        listed(F.flatten(F.transform(lineas, lambda x: x["palabras"])), lambda w: F.concat_ws(":", w["texto"], w["confianza"].cast("bigint").cast("string"), nums(w["coordenadas"]))).alias("palabras"),
        listed("j.columnas", lambda c: F.concat_ws(":", c["columna_id"].cast("string"), F.concat_ws("-", c["x_inicio"].cast("string"), c["x_fin"].cast("string")), nums(c["bloques_ids"]))).alias("columnas"),
    )


@query("s6_output_name", "SELECT page_id, 'page' || page_id || '_2026-03-01_14-30-25.txt' AS name FROM pages")
def s6(spark, d):
    path = F.concat(F.lit("/data/in.d/page"), "page_id", F.lit(".PNG"))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.output_name(path, F.lit("2026-03-01 14:30:25").cast("timestamp"), "txt").alias("name"))


@query("s7_export_paragraphs", sql(PARAGRAPHS_SQL))
def s7(spark, d):
    p = pages(spark, d)
    return S.export_paragraphs(p.docs, p.placed)


# Workloads.
def workload_a_sql() -> str:
    limit = "CASE image_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 3 END"
    cand = f"SELECT *, par_num * 1000 + line_num AS line_key FROM (SELECT * EXCLUDE (text), {trim('text')} AS text FROM candidate_words) WHERE text <> '' AND conf >= {limit} AND text NOT IN ('|', '~', '`', '^')"
    words = f"""SELECT c.* EXCLUDE (text), CASE WHEN height > 0 AND width::DOUBLE / greatest(height, 1) BETWEEN 0.7 AND 1.4 AND text IN ({RADIO_SQL}) AND width < 60 THEN '○' ELSE text END AS text
      FROM cand c JOIN best b ON c.image_id = b.image_id AND c.variant = b.variant AND c.psm = b.psm"""
    return documents_sql({"cand": cand, "scores": CTES["scores"], "phases": CTES["phases"], "best": CTES["best"], "words": words})


@query("workload_a_documents", workload_a_sql())
def workload_a(spark, d):
    every = page_ids(spark, d)
    return document_rows(recognised_documents(X.candidate_words(spark, d), rated(every), mode_order(every), pages=every, dealt=True).docs)


def rated(pages: DataFrame) -> DataFrame:
    third = F.col("image_id") % 3
    return pages.select("image_id", F.when(third == 0, 15.0).when(third == 1, 8.0).otherwise(3.0).alias("suggested_confidence"))


def mode_order(pages: DataFrame) -> DataFrame:
    return pages.select("image_id", F.array(F.lit(3), F.lit(6)).alias("psm_order"))


def account_sql(select: str) -> str:
    """Pages with an id of 3 modulo 17 have no quality row, those of 5 modulo 13 no candidate; half of those of 7 modulo 11
    have candidates without words that reach the threshold."""
    limit = "CASE image_id % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 3 END"
    return sql(f"""SELECT * FROM candidate_words""").replace("SELECT * FROM candidate_words", f""", given AS (SELECT * EXCLUDE (conf), CASE WHEN image_id % 11 = 7 AND image_id % 2 = 0 THEN 1.0 ELSE conf END AS conf FROM candidate_words WHERE image_id % 13 <> 5),
      left_words AS (SELECT image_id, variant, psm, {trim('text')} AS text, conf FROM given WHERE {trim('text')} <> '' AND conf >= {limit} AND image_id % 17 <> 3 AND {trim('text')} NOT IN ('|', '~', '`', '^')),
      scores AS ({CTES['scores'].replace('FROM cand GROUP', 'FROM left_words GROUP')}), phases AS ({CTES['phases']}), best AS ({CTES['best']}),
      won AS (SELECT w.image_id, count(*) AS word_count FROM left_words w JOIN best b ON w.image_id = b.image_id AND w.variant = b.variant AND w.psm = b.psm GROUP BY w.image_id),
      tried AS (SELECT image_id, count(DISTINCT variant * 100 + psm) AS attempts FROM given GROUP BY image_id),
      account AS (SELECT image_id, CASE WHEN image_id % 17 = 3 THEN 'no_quality' WHEN attempts = 0 THEN 'all_failed' WHEN word_count = 0 THEN 'empty' ELSE 'exported' END AS outcome, attempts, word_count FROM (
        SELECT d.doc_id AS image_id, coalesce(attempts, 0) AS attempts, coalesce(word_count, 0) AS word_count FROM documents d LEFT JOIN tried t ON t.image_id = d.doc_id LEFT JOIN won w ON w.image_id = d.doc_id))
      {select}""")


def accounted(spark, d) -> DataFrame:
    id_ = F.col("image_id")
    words = X.candidate_words(spark, d).where(id_ % 13 != 5).withColumn("conf", F.when((id_ % 11 == 7) & (id_ % 2 == 0), 1.0).otherwise(F.col("conf")))
    every = page_ids(spark, d)
    return recognised_account(words, rated(every.where(id_ % 17 != 3)), mode_order(every), every)


@query("a1_page_account", account_sql("SELECT image_id, outcome, attempts, word_count FROM account"))
def a1(spark, d):
    return accounted(spark, d)


@query("a2_page_rejects", account_sql("SELECT image_id, outcome, CASE outcome WHEN 'no_quality' THEN 'no quality row' WHEN 'all_failed' THEN 'no candidate brought words' ELSE 'no word was left' END AS note, attempts FROM account WHERE outcome <> 'exported'"))
def a2(spark, d):
    return W.rejected_pages(accounted(spark, d))


TASKS_SQL = f"""WITH {FEAT}, segments AS ({X.SEGMENTS.replace('{lineitem}', 'lineitem')}), contours AS ({X.CONTOURS.replace('{lineitem}', 'lineitem')}),
  b AS (SELECT image_id, t, (SELECT count(*) FROM pix p WHERE p.image_id = k.image_id AND p.v <= t) AS n0, (SELECT sum(v) FROM pix p WHERE p.image_id = k.image_id AND p.v <= t) AS s0,
    (SELECT sum(v) FROM pix p WHERE p.image_id = k.image_id) AS s FROM (SELECT DISTINCT image_id, v AS t FROM pix) k),
  o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n0 * (64 - n0) * power(s0 / n0 - (s - s0) / (64 - n0)::DOUBLE, 2) DESC, t) AS place FROM b WHERE n0 < 64),
  h AS (SELECT image_id, count(*) FILTER (purpose = 'layout' AND abs(degrees(atan2(y2 - y1, x2 - x1))) < 5) AS hl FROM segments GROUP BY image_id),
  c AS (SELECT image_id, count(*) FILTER (area > 64 * 0.0005) AS nb FROM contours GROUP BY image_id),
  ranked AS (SELECT f.image_id, ss, coalesce(hl, 0) AS hl, coalesce(nb, 0) AS nb, n0 / 64.0::DOUBLE AS td FROM feat f JOIN o ON f.image_id = o.image_id AND place = 1 LEFT JOIN h ON f.image_id = h.image_id LEFT JOIN c ON f.image_id = c.image_id),
  points AS (SELECT image_id, ss, 2 + (CASE WHEN hl >= 5 THEN 1 ELSE 0 END) + (CASE WHEN td > 0.08 AND td <= 0.15 THEN 1 ELSE 0 END) + (CASE WHEN nb < 5 THEN 1 ELSE 0 END) AS s3,
    (CASE WHEN hl >= 5 THEN 2 ELSE 0 END) + (CASE WHEN td > 0.15 THEN 2 WHEN td > 0.08 THEN 1 ELSE 0 END) + (CASE WHEN nb > 20 THEN 1 ELSE 0 END) AS s6 FROM ranked)
  SELECT image_id, CAST(v AS INT) AS variant, CASE WHEN (r = 1) = (s6 > s3) THEN 6 ELSE 3 END AS psm, r AS psm_rank, CASE WHEN v >= 3 THEN '2' WHEN r = 1 THEN '1A' ELSE '1B' END AS phase
  FROM (SELECT *, unnest(range(CASE WHEN ss THEN 6 ELSE 5 END)) AS v FROM points), (SELECT unnest([1, 2]) AS r)"""


@query("workload_b_tasks", TASKS_SQL)
def workload_b(spark, d):
    return C.task_grid(plan_recognition(X.images(spark, d), X.segments(spark, d), X.contours(spark, d), resize=False))


LARGE_TASKS_SQL = TASKS_SQL.replace(FEAT, CELL_FEAT).replace("64 - n0", "144 - n0").replace("n0 < 64", "n0 < 144").replace("n0 / 64.0", "n0 / 144.0").replace("64 * 0.0005", "360000 * 0.0005").replace("SELECT f.image_id, ss,", "SELECT f.image_id, 1.0 + f.image_id % 2 / 6.0 AS a, ss,").replace("SELECT image_id, ss, 2 +", "SELECT image_id, ss, CASE WHEN a <= 1 THEN 2 ELSE 0 END +").replace("ELSE 0 END) AS s3,\n    (CASE", "ELSE 0 END) AS s3,\n    (CASE WHEN a > 2 THEN 3 WHEN a > 1 THEN 2 ELSE 0 END) + (CASE")


@query("workload_b_large_tasks", LARGE_TASKS_SQL)
def workload_b_large(spark, d):
    return C.task_grid(plan_recognition(X.large_images(spark, d), X.segments(spark, d), X.contours(spark, d)))


def workload_c_sql() -> str:
    inner = "SELECT image_id, line_no, line FROM exam_lines"
    for step in T9_STEPS:
        inner = f"SELECT image_id, line_no, {step} AS line FROM ({inner})"
    own = {"fixed_lines": inner} | {k: CTES[k] for k in LAID_OUT[LAID_OUT.index("marked") :]}
    own["marked"] = CTES["marked"].replace("exam_lines", "fixed_lines")
    body = ", ".join(f"{k} AS ({v})" for k, v in own.items())
    return X.duck(f", {body} SELECT h.image_id, CAST(h.q_no AS BIGINT) AS q_no, h.s AS header, {LISTS} FROM segs h WHERE h.is_head")


@query("workload_c_questions", workload_c_sql())
def workload_c(spark, d):
    lines = X.exam_lines(spark, d).withColumn("line", R.fix_ocr_text(F.col("line")))
    return E.extract_questions(lines).select("image_id", "q_no", "header", *[F.concat_ws("|", c).alias(c) for c in ("statement", "code", "options")])
