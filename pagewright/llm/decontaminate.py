"""Benchmark decontamination by winnowing, with built-in functions only.

Both sides keep the least k-gram hash of every window of WINNOW grams, so two texts that share GRAM + WINNOW - 1
words in a row share a fingerprint at the same alignment. Fingerprints join on their hash; each alignment they
propose is then checked word by word, which settles hash collisions and finds where shared windows begin and end.
Benchmark items shorter than a window are matched whole: a fingerprint over all their words.

The documents are read three times (fingerprints, texts of candidates, word counts) and never shuffled while the
benchmark's fingerprints and the candidates stay within a measured bound; beyond it both joins shuffle. The alignments
of a document are gathered before its text meets them, so a text is split into words once, however many there are.

Documents are told apart by id and text, null ids included, so rows that share an id are judged each by its own text.
Null text has no words: such documents are clean, such items occur nowhere. Items with one id count once; those
without an id count as one item, which hits words but has no name in the digest. An empty benchmark leaves every
document clean, an empty table gives an empty result; further columns are not looked at. A text of more than 67,108,864
words raises an error, since positions would run into the hashes. Words: A-Z in lower case,
runs of digits, a-z and anything beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import free_name, let, saved, small_side, text_hash, text_or_empty, workspace

SPAN = 13
GRAM = 5
WINNOW = SPAN - GRAM + 1
#: A fingerprint is one long: the upper bits hold the hash, the lower ones the position of its gram. A text of more than
#: 2**POSITION_BITS words is an error, not a text with lost hits.
POSITION_BITS = 26
#: A document is contaminated from this share of hit words: 20 * n_hit >= n_words.
HIT_FACTOR = 20

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "array<struct<s:int,e:int>>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def placed(hash_: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftright(hash_, POSITION_BITS), POSITION_BITS) + position


def gram_hashes(w: Column, k: int) -> Column:
    """Hash of every ``k`` words in a row, with its position; empty if there are fewer words."""
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: placed(F.xxhash64(F.lit(k), F.slice(w, i + 1, k)), i)),
    ).otherwise(F.array().cast("array<bigint>"))


def winnowed(w: Column) -> Column:
    """The least fingerprint of every ``WINNOW`` grams in a row, each once."""
    return F.when(
        F.size(w) >= SPAN,
        let(gram_hashes(w, GRAM), lambda g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (WINNOW - 1)), lambda i: F.array_min(F.slice(g, i, WINNOW))))),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(w: Column, short: list[int]) -> Column:
    """Winnowed grams, and all grams of each length in ``short``; tagged with the gram length."""
    tag = lambda k: lambda f: F.struct(F.shiftright(f, POSITION_BITS).alias("fp"), F.lit(k).alias("k"), f.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("at"))
    return F.concat(F.transform(winnowed(w), tag(GRAM + SPAN)), *[F.transform(gram_hashes(w, k), tag(k)) for k in short])


def within_positions(w: Column, found: Column) -> Column:
    """``found``, or an error where ``w`` has more words than positions can tell apart."""
    most = 1 << POSITION_BITS
    return F.when(F.size(w) <= most, found).otherwise(F.raise_error(F.lit(f"a text of more than {most} words")).cast("array<struct<fp:bigint,k:int,at:int>>"))


def shared_runs(w: Column, item: Column, shift: Column) -> Column:
    """Word ranges of the document that item windows cover, where item word i lies on document word i + shift."""
    n = F.least(F.lit(SPAN), F.size(item))
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(w) - shift) - n
    starts = F.when(
        first <= last,
        F.filter(F.sequence(first, last), lambda i: F.slice(w, i + shift + 1, n) == F.slice(item, i + 1, n)),
    ).otherwise(F.array().cast("array<int>"))

    def grow(acc: Column, i: Column) -> Column:
        s, e = (i + shift).cast("int"), (i + shift + n).cast("int")
        top = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["s"].alias("s"), e.alias("e"))))
        return F.when((F.size(acc) > 0) & (s <= top["e"]), wider).otherwise(F.concat(acc, F.array(F.struct(s.alias("s"), e.alias("e"))))).cast(RUNS)

    return F.aggregate(starts, F.array().cast(RUNS), grow)


def covered(runs: Column) -> Column:
    """Number of places in the union of ``runs``."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(runs), state, add, lambda acc: acc["n"])


def same_document(docs: DataFrame, keys: DataFrame) -> Column:
    """``keys`` has the columns did and dh; ``docs`` doc_id and h."""
    return (docs["h"] == keys["dh"]) & docs["doc_id"].eqNullSafe(keys["did"])


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """did, dh, hits: for each document that shares a fingerprint, the items (id, words) with the places where word 0
    of the item would lie in the document."""
    items = benchmark.select("item_id", words(text_or_empty()).alias("item")).where("size(item) > 0")
    items = saved(items.withColumn("no", F.monotonically_increasing_id()))
    lengths = items.select(F.least(F.size("item"), F.lit(SPAN)).alias("n")).distinct().collect()  # at most SPAN rows
    short = sorted(r["n"] for r in lengths if r["n"] < SPAN)
    whole = [F.when(F.size("item") == k, fingerprints(F.col("item"), [k])).otherwise(F.array().cast("array<struct<fp:bigint,k:int,at:int>>")) for k in short]
    item_prints = saved(items.select("no", F.explode(F.concat(fingerprints(F.col("item"), []), *whole)).alias("f")).select("no", "f.fp", "f.k", F.col("f.at").alias("item_at")))
    prints = docs.select("doc_id", "h", F.explode(let(words(F.col("text")), lambda w: within_positions(w, fingerprints(w, short)))).alias("f")).select("doc_id", "h", "f.fp", "f.k", "f.at")
    met = prints.join(small_side(item_prints), ["fp", "k"]).groupBy("doc_id", "h", "no").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    named = met.join(small_side(items), "no").select("doc_id", "h", F.struct("item_id", "item", "shifts").alias("hit"))
    return named.groupBy(F.col("doc_id").alias("did"), F.col("h").alias("dh")).agg(F.collect_list("hit").alias("hits"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash().alias("h"), text_or_empty().alias("text"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """did, dh, n_hit, items (their ids), contaminated: of the documents with a hit, as a saved table."""
    with workspace(docs.sparkSession) as keep:
        docs = keyed(docs)
        met = saved(alignments(docs, benchmark))

        def checked(w: Column, hits: Column) -> Column:
            runs = lambda x: F.flatten(F.transform(x["shifts"], lambda shift: shared_runs(w, x["item"], shift)))
            return F.filter(F.transform(hits, lambda x: F.struct(x["item_id"].alias("item_id"), runs(x).alias("runs"))), lambda x: F.size(x["runs"]) > 0)

        both = docs.join(small_side(met), same_document(docs, met))
        found = both.select("did", "dh", let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), checked(w, F.col("hits")).alias("hits"))).alias("x")).where(F.size("x.hits") > 0)
        n_hit = covered(F.flatten("x.hits.runs"))
        found = found.select("did", "dh", F.col("x.n_words").alias("n_words"), n_hit.alias("n_hit"), F.array_distinct(F.col("x.hits.item_id").cast("array<string>")).alias("items"))
        # Rows alike in id and text are judged alike.
        out = saved(found.select("did", "dh", "n_hit", "items", (HIT_FACTOR * F.col("n_hit") >= F.col("n_words")).alias("contaminated")).dropDuplicates(["did", "dh"]))
        keep.append(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``."""
    found = judged(docs, benchmark)
    counted = keyed(docs).select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(small_side(found), same_document(counted, found), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own text."""
    gone = saved(judged(docs, benchmark).where("contaminated").select("did", "dh"))
    h = free_name(docs)
    own = docs.withColumn(h, text_hash())
    return own.join(small_side(gone), (own[h] == gone["dh"]) & own["doc_id"].eqNullSafe(gone["did"]), "left_anti").drop(h)
