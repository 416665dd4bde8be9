r"""Ranked lexical search: an inverted index in shards, searched with Block-Max MaxScore.

A text's terms are its runs of digits, letters and anything beyond ASCII, A-Z in lower case. With N the documents that
hold a term, L all their terms, df the documents that hold a given one, n a document's terms and tf occurrences:

    w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 100 - 25 + 25 n N div L,
    score = sum over the query's terms, repeats included, of w * (1000000000 tf div (1000 tf + 12 m))

Index. A task cuts its documents into shards, closed by (document, term) pairs or documents, whichever comes first, and
writes one row for each term of a shard: its postings in blocks of ``BLOCK``, packed as steps and frequencies in as few
bytes as a block needs, and outside the packed bytes, for each block, the last place and the pairs of frequency and
length that no other pair of the block beats in both. From those follow the greatest impacts of blocks and lists for
any N and L, so an index stays right as documents are added. No shuffle is needed; a very long text is one posting for
each of its terms.

Search. Queries form blocks of ``QUERY_BLOCK``; terms bring a shard's lists and the queries of a block together, and each
(shard, block) is one group, of bounded size whatever the number of documents, queries or uses of a term. For each query
the lists are sorted by their greatest contribution. Those whose sum stays below the lowest score of a full heap are not
essential: only documents of the others become candidates. A candidate's bound is then tightened by the block maxima of
the non-essential lists, without unpacking them; blocks are unpacked for those candidates alone that may still enter the
heap. Each shard's heap goes on; the best of all heaps are taken by rank, cut to ``k`` rows before they move.

Equal scores are ranked by ascending doc_id, null first. Rows are documents of their own, repeated ones included. Null
texts have no terms; documents and items without terms are in no result. Items are told apart by id and text: rows alike
in both count once. Empty tables give an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import rows_of, saved, small_side, text_or_empty, workspace
from pagewright.llm.wordscan import Texts, row_index, slices

TOP = 20
BLOCK = 128
QUERY_BLOCK = 256
#: A shard is closed when it has so many (document, term) pairs, or so many documents; places fit two bytes.
SHARD_PAIRS, SHARD_DOCS = 1 << 20, 1 << 15
#: Places that are scored at once.
STRIDE = 4096
#: The term of the row that holds a shard's documents.
DOCUMENTS = ""

CODES = np.arange(256)
TERM_BYTE = (CODES >= 128) | ((CODES >= 48) & (CODES < 58)) | ((CODES >= 65) & (CODES < 91)) | ((CODES >= 97) & (CODES < 123))
LOWERED = np.where((CODES >= 65) & (CODES < 91), CODES + 32, CODES).astype(np.uint8)

INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("last", pa.list_(pa.int32())), ("widths", pa.list_(pa.int8())), ("peaks", pa.list_(pa.int32())), ("peak_tf", pa.list_(pa.int64())), ("peak_length", pa.list_(pa.int64())), ("packed", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)
INDEX_DDL = "shard bigint, term string, n bigint, last array<int>, widths array<tinyint>, peaks array<int>, peak_tf array<bigint>, peak_length array<bigint>, packed binary, ids array<bigint>, lengths array<bigint>"


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row, term (a place in the fourth) and occurrences of each pair of row and term; the terms; terms of each row."""
    t = Texts(texts)
    starts, ends, off = t.words(TERM_BYTE)
    data = LOWERED[t.bytes[TERM_BYTE[t.bytes]]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    kinds = max(1, len(words.dictionary))
    key, count = np.unique(row_index(off) * kinds + words.indices.to_numpy(), return_counts=True)
    return key // kinds, key % kinds, count, words.dictionary, np.diff(off)


class Shard:
    """Postings of consecutive documents, until they are packed."""

    def __init__(self):
        self.place, self.term, self.tf, self.names, self.ids, self.lengths = [], [], [], [], [], []
        self.docs = self.pairs = self.known = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        row, term, count, names, lengths = term_counts(texts)
        for into, new in ((self.place, row + self.docs), (self.term, term + self.known), (self.tf, count), (self.names, names), (self.ids, ids), (self.lengths, lengths)):
            into.append(new)
        self.docs, self.pairs, self.known = self.docs + len(ids), self.pairs + len(row), self.known + len(names)

    def packed(self, shard: int) -> pa.RecordBatch:
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        names = pa.concat_arrays(self.names).dictionary_encode()
        term = names.indices.to_numpy()[np.concatenate(self.term)] if self.pairs else np.zeros(0, np.int64)
        place, tf = np.concatenate(self.place), np.concatenate(self.tf)
        order = np.lexsort((place, term))
        return packed_lists(shard, names.dictionary, term[order], place[order], tf[order], ids, lengths)


def packed_lists(shard: int, names: pa.Array, term: np.ndarray, place: np.ndarray, tf: np.ndarray, ids: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
    """The index rows of a shard: one for each term, and one for its documents. Pairs come by term, then place."""
    n = len(term)
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    within = np.arange(n) - np.repeat(first, size)
    opens = np.flatnonzero(within % BLOCK == 0)
    block = np.cumsum(within % BLOCK == 0) - 1
    count = np.diff(np.append(opens, n))
    step = place - np.where(within == 0, -1, np.concatenate([[0], place[:-1]]))
    greatest = lambda x: np.maximum.reduceat(x, opens) if n else x
    step_width = np.where(greatest(step) < 1 << 8, 1, 2)
    tf_width = np.select([greatest(tf) < 1 << 8, greatest(tf) < 1 << 16], [1, 2], 8)
    base = np.concatenate([[0], np.cumsum(count * (step_width + tf_width))]).astype(np.int64)
    data = np.zeros(int(base[-1]), np.uint8)
    nth = within % BLOCK
    for values, width, at in ((step, step_width, base[:-1]), (tf, tf_width, base[:-1] + count * step_width)):
        wide = width[block]
        begin = at[block] + nth * wide
        for byte in range(8):
            some = np.flatnonzero(wide > byte)
            data[begin[some] + byte] = (values[some] >> (8 * byte)) & 255
    # By block, from the highest frequency down: pairs whose length is below those of all before.
    length = lengths[place] if n else place
    order = np.lexsort((length, -tf, block))
    falling = length[order] - block[order] * (int(length.max()) + 1 if n else 1)
    best = np.minimum.accumulate(falling) if n else falling
    peak = order[np.concatenate([[True], falling[1:] < best[:-1]])] if n else order
    peaks_of = np.bincount(block[peak], minlength=len(opens))

    blocks = -(-size // BLOCK)
    to = lambda counts: np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    by_term = to(blocks)
    lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1])), pa.array(values, kind))  # noqa: E731  the last row: none
    peak_ends = np.concatenate([[0], np.cumsum(peaks_of)])[by_term].astype(np.int32)
    ends = base[by_term].astype(np.int32)
    nothing = pa.array([None] * len(first), pa.list_(pa.int64()))
    last_row = lambda values: pa.concat_arrays([nothing, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, shard)),
            pa.concat_arrays([names.take(pa.array(term[first])).cast(pa.large_string()).cast(pa.string()), pa.array([DOCUMENTS])]),
            pa.array(np.append(size, len(lengths))),
            lists(by_term, place[np.append(opens[1:], n) - 1] if n else place, pa.int32()),
            lists(by_term, step_width * 16 + tf_width, pa.int8()),
            lists(by_term, peaks_of, pa.int32()),
            lists(peak_ends, tf[peak], pa.int64()),
            lists(peak_ends, length[peak], pa.int64()),
            pa.Array.from_buffers(pa.binary(), len(first) + 1, [None, pa.py_buffer(np.append(ends, ends[-1])), pa.py_buffer(data)]),
            last_row(ids),
            last_row(pa.array(lengths.astype(np.int64))),
        ],
        schema=INDEX,
    )


def build_index(docs: DataFrame, terms: DataFrame | None = None, pairs: int = SHARD_PAIRS, most_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of ``docs`` (doc_id, text) as a saved table; with ``terms`` (term), lists of those only. A shard is
    closed from ``pairs`` on, and holds ``most_docs`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = Shard()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for lo in range(0, part.num_rows, most_docs):
                    piece = part.slice(lo, most_docs)
                    if shard.docs + piece.num_rows > most_docs or shard.pairs >= pairs:
                        yield shard.packed(number)
                        shard, number = Shard(), number + 1
                    shard.add(piece.column("doc_id"), piece.column("text"))
        if shard.docs:
            yield shard.packed(number)

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, INDEX_DDL)
    if terms is not None:
        index = index.join(small_side(terms), "term", "left_semi").select(*INDEX.names)
    return saved(index, sized=False)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Postings:
    """One term's list in a shard. Blocks are unpacked when they are asked for; the places of others stand at the last
    place of their block, so that all places ascend."""

    def __init__(self, row: dict, m_of: Callable[[np.ndarray], np.ndarray], m: np.ndarray):
        self.n, self.m, self.packed = row["n"], m, row["packed"]
        self.last = np.asarray(row["last"])
        widths = np.asarray(row["widths"], np.int64)
        self.step_width, self.tf_width = widths >> 4, widths & 15
        self.count = np.full(len(self.last), BLOCK)
        self.count[-1] = self.n - BLOCK * (len(self.last) - 1)
        self.base = np.concatenate([[0], np.cumsum(self.count * (self.step_width + self.tf_width))])
        opens = np.concatenate([[0], np.cumsum(row["peaks"])])[:-1]
        self.most = np.maximum.reduceat(impact(np.asarray(row["peak_tf"]), m_of(np.asarray(row["peak_length"]))), opens)
        self.top = int(self.most.max())
        self.place = np.repeat(self.last, self.count)
        self.impact = np.zeros(self.n, np.int64)
        self.open = np.zeros(len(self.last), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]]:
            c, at, sw, tw = self.count[b], self.base[b], self.step_width[b], self.tf_width[b]
            steps = np.frombuffer(self.packed, f"<u{sw}", c, at)
            tf = np.frombuffer(self.packed, f"<u{tw}", c, at + c * sw).astype(np.int64)
            lo = b * BLOCK
            self.place[lo : lo + c] = (self.last[b - 1] if b else -1) + np.cumsum(steps, dtype=np.int64)
            self.impact[lo : lo + c] = impact(tf, self.m[self.place[lo : lo + c]])
            self.open[b] = True

    def between(self, lo: int, hi: int) -> slice:
        """The postings with places from ``lo`` to below ``hi``, unpacked."""
        b0, b1 = np.searchsorted(self.last, [lo, hi])
        self.unpack(np.arange(b0, min(b1 + 1, len(self.last))))
        i, j = np.searchsorted(self.place, [lo, hi])
        return slice(i, j)

    def bounds(self, places: np.ndarray) -> np.ndarray:
        """The greatest impact in the block of each place; 0 beyond the last."""
        b = np.searchsorted(self.last, places)
        return np.where(b < len(self.last), self.most[np.minimum(b, len(self.last) - 1)], 0)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The impact at each place, 0 where the term is not."""
        b = np.unique(np.searchsorted(self.last, places))
        self.unpack(b[b < len(self.last)])
        i = np.minimum(np.searchsorted(self.place, places), self.n - 1)
        return np.where(self.place[i] == places, self.impact[i], 0)


def top_places(lists: list[tuple[int, Postings]], docs: int, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best places of a shard and their scores, for (weight, list) of each term. ``order`` ranks places of
    equal score."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    most = np.cumsum([0, *(w * p.top for w, p in lists)])
    best, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for lo in range(0, docs, STRIDE):
        hi = min(lo + STRIDE, docs)
        rest = int(np.searchsorted(most, least)) - 1  # lists that cannot reach ``least`` together
        if rest == len(lists):
            break
        sums = np.zeros(hi - lo, np.int64)
        for w, p in lists[rest:]:
            some = p.between(lo, hi)
            sums[p.place[some] - lo] += w * p.impact[some]
        at = np.flatnonzero(sums + most[rest] >= max(least, most[rest] + 1))
        sums = sums[at]
        at = at + lo
        if rest and len(at):
            blocks = [w * p.bounds(at) for w, p in lists[:rest]]
            ahead = np.cumsum(blocks, axis=0)
            for j in range(rest - 1, -1, -1):
                may = sums + ahead[j] >= least
                at, sums, ahead = at[may], sums[may], ahead[:, may]
                if not len(at):
                    break
                sums = sums + lists[j][0] * lists[j][1].at(at)
        new = sums >= least
        best, score = np.concatenate([best, at[new]]), np.concatenate([score, sums[new]])
        if len(best) > k:
            first = np.lexsort((order[best], -score))[:k]
            best, score = best[first], score[first]
        if len(best) == k:
            least = max(1, int(score.min()))
    return best, score


def query_terms(items: DataFrame) -> DataFrame:
    """query, term, times: the terms of each row of ``items`` (query, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                row, term, count, names, _ = term_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(row)), names.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()), pa.array(count.astype(np.int64))], ["query", "term", "times"])

    return items.select("query", "text").mapInArrow(run, "query bigint, term string, times bigint")


def weight(n: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2 * df + 1).cast("double"))).cast("long")


def numbered(items: DataFrame) -> DataFrame:
    """query (a number), item_id and text of each different item, as a saved table."""
    return saved(items.select("item_id", text_or_empty().alias("text")).distinct().withColumn("query", F.monotonically_increasing_id()))


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents. ``index``: of ``build_index``, with the terms
    of ``items`` at least. ``items``: item_id, text, or a table of ``numbered``."""
    with workspace(index.sparkSession) as keep:
        queries = items if "query" in items.columns else numbered(items)
        uses = saved(query_terms(queries))
        size = index.where(F.col("term") == DOCUMENTS).select(F.size(F.filter("lengths", lambda x: x > 0)).cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
        total = size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
        n, all_terms = total["n"], max(1, total["l"])
        wanted = saved(uses.select("term").distinct())
        found = index.select("term", "n").join(small_side(wanted), "term").groupBy("term").agg(F.sum("n").alias("df"))
        weighted = found.select("term", weight(n, F.col("df")).alias("w"))
        groups = max(1, -(-rows_of(queries) // QUERY_BLOCK))
        block = F.pmod(F.xxhash64("query"), F.lit(groups))
        asked = uses.join(weighted, "term").groupBy(block.alias("block"), "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("query", "times")).alias("uses"))
        everywhere = uses.sparkSession.range(groups).select(F.col("id").alias("block"), F.lit(DOCUMENTS).alias("term"), F.lit(0).cast("long").alias("w"), F.array().cast("array<struct<query:bigint,times:bigint>>").alias("uses"))
        asked = saved(asked.unionByName(everywhere))

        def run(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            out = ([], [], [])
            shard = next((r for r in rows if r["term"] == DOCUMENTS), None)
            if shard is not None:
                m_of = lambda length: 75 + (25 * length * n) // all_terms
                m = m_of(np.asarray(shard["lengths"], np.int64))
                ids = pa.array(shard["ids"], pa.int64())
                order = np.empty(len(m), np.int64)
                order[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(len(m))
                of: dict[int, list[tuple[int, Postings]]] = {}
                for r in rows:
                    if r["term"] != DOCUMENTS:
                        p = Postings(r, m_of, m)
                        for use in r["uses"]:
                            of.setdefault(use["query"], []).append((r["w"] * use["times"], p))
                for query, lists in of.items():
                    best, score = top_places(lists, len(m), order, k)
                    out[0].append(np.full(len(best), query))
                    out[1].append(ids.take(pa.array(best)))
                    out[2].append(score)
            names = ["query", "doc_id", "score"]
            if not out[0]:
                return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names)
            return pa.Table.from_arrays([pa.array(np.concatenate(out[0]).astype(np.int64)), pa.concat_arrays(out[1]), pa.array(np.concatenate(out[2]).astype(np.int64))], names)

        met = index.join(small_side(asked), "term")
        heaps = met.groupBy("shard", "block").applyInArrow(run, "query bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = saved(ranked.join(small_side(queries.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score"))
        keep.append(out)
    return out


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents for each item, by an index of the items' terms only."""
    with workspace(docs.sparkSession) as keep:
        queries = numbered(items)
        terms = query_terms(queries).select("term").distinct()
        marker = docs.sparkSession.range(1).select(F.lit(DOCUMENTS).alias("term"))
        out = search(build_index(docs, saved(terms.unionByName(marker))), queries, k)
        keep.append(out)
    return out


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEARCH_SQL = f"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{TERMS}')) AS term FROM documents
), pairs AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM pairs GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM pairs, totals GROUP BY term, docs
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{TERMS}')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT a.item_id, p.doc_id, sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * l.n * docs) // terms))))::BIGINT AS score
  FROM asked a JOIN weights w ON a.term = w.term JOIN pairs p ON p.term = a.term JOIN lengths l ON l.doc_id = p.doc_id, totals GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
