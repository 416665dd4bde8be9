r"""Line dedup with built-in functions only: lines that many documents share go from all but one of them.

A text's lines are split at \n. A line's key is the line without blanks at both ends, A-Z in lower case. Keys of at
least ``LEAST_CHARS`` code points found in at least ``LEAST_DOCS`` documents lose all their lines, repeats included,
except in the document of the largest doc_id that holds the key.

Work and data movement:

* lines are exploded once, and only those long enough go on, as two 64-bit hashes of their key with document and
  position: some 50 bytes a line, written as a table. Texts stay where they are;
* distinct documents are counted by the built-in distinct count: pairs of key and document are combined where they lie
  and once more by pair, counts once more by key, so a line that a third of all documents hold is a few rows per task;
* keys to drop meet the lines by broadcast while they are small; beyond that the keys of ``OFTEN`` or more documents,
  which are few by their nature, still do, and only the others shuffle, so no key brings a task more than its share;
* the positions to drop, gathered by document, meet the texts by broadcast while they are small, else by document; a
  text is put together again from the stretches between them, in one pass.

Keys are compared by 128 bits of hash. Documents are told apart by id and text. Rows with one id are one document, both
for counts and as the keeper of a line. Rows without an id are one document for each text; they keep a line only if no
document with an id holds it (then the one of the largest text hash does). Rows alike in id and text get equal results.
Null text counts as empty, and an empty text is one empty line. An empty table gives an empty result; other columns
are carried along by ``drop_shared_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import free_name, is_small, let, rows_of, saved, small_side, text_or_empty, workspace

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Documents from which a key's lines are looked up by broadcast at any size.
OFTEN = 10_000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY, DOC = ["k1", "k2"], ["id", "t1", "t2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def two_hashes(value: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs, which grouping and joins take as they are."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """id, t1, t2 (the document), at (from 0), k1, k2 (the key), for each line with a key of enough code points."""
    t1, t2 = two_hashes(text_or_empty())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(lines_of(text_or_empty())).alias("at", "line"))
    keyed = rows.where(F.length("line") >= least_chars).select(*DOC, "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    k1, k2 = two_hashes(F.col("key"))
    return keyed.select(*DOC, "at", k1.alias("k1"), k2.alias("k2"))


def shared_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """k1, k2, n (documents that hold the key), and the keeper: last_id, or last_text where no holder has an id."""
    unnamed = F.when(F.col("id").isNull(), F.col("t1"))
    found = lines.withColumn("unnamed", unnamed).groupBy(*KEY).agg(F.count_distinct(F.coalesce("id", "unnamed")).alias("n"), F.max("id").alias("last_id"), F.max("unnamed").alias("last_text"))
    return found.where(F.col("n") >= least_docs)


def lost_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines whose key is shared, outside the key's keeper. Both are tables from ``saved``."""

    def met(keys: DataFrame) -> DataFrame:
        kept = F.when(F.col("last_id").isNotNull(), F.col("id").eqNullSafe(F.col("last_id"))).otherwise(F.col("t1") == F.col("last_text"))
        return lines.join(keys.select(*KEY, "last_id", "last_text"), KEY).where(~kept).select(*DOC, "at")

    if is_small(shared):
        return met(F.broadcast(shared))
    often = saved(shared.where(F.col("n") >= OFTEN))
    return met(small_side(often)).unionAll(met(shared.where(F.col("n") < OFTEN)))


def without(lines: Column, gone: Column) -> Column:
    """``lines`` but those at the ascending positions ``gone``: the stretches between them, in turn."""
    stretch = lambda at, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(gone, i - 1) + 2), at - F.when(i == 0, -1).otherwise(F.get(gone, i - 1)) - 1)
    return F.flatten(F.transform(F.concat(gone, F.array(F.size(lines))), stretch))


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with ``text`` as it is left, and n_lines (before) and n_dropped; further columns as they are."""
    own = free_name(docs)
    with workspace(docs.sparkSession) as keep:
        lines = saved(long_lines(docs, least_chars), sized=False)
        most = rows_of(lines)  # neither keys nor documents are more than lines, so few lines make few files
        shared = saved(shared_keys(lines, least_docs), rows=most)
        lost = saved(lost_lines(lines, shared).groupBy(*DOC).agg(F.array_sort(F.collect_set("at")).alias("gone")), rows=most)
        keep.append(lost)
    t1, t2 = two_hashes(text_or_empty())
    rows = docs.withColumns({f"{own}t1": t1, f"{own}t2": t2})
    if rows_of(lost):
        at = small_side(lost.select(*[F.col(c).alias(f"{own}_{c}") for c in (*DOC, "gone")]), size_of=lost)
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}_id")) & (F.col(f"{own}t1") == F.col(f"{own}_t1")) & (F.col(f"{own}t2") == F.col(f"{own}_t2"))
        rows = rows.join(at, same, "left").withColumn(f"{own}gone", F.coalesce(f"{own}_gone", F.array().cast("array<int>")))
    else:
        rows = rows.withColumn(f"{own}gone", F.array().cast("array<int>"))
    left = F.when(F.size(f"{own}gone") == 0, text_or_empty()).otherwise(let(lines_of(text_or_empty()), lambda x: F.array_join(without(x, F.col(f"{own}gone")), "\n")))
    return rows.select(
        *[left.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        (F.length(text_or_empty()) - F.length(F.replace(text_or_empty(), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.size(f"{own}gone").cast("long").alias("n_dropped"),
    )


def lines_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    return drop_shared_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.last_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
