"""Substring deduplication: words inside any repeated window of ``WINDOW`` words go.

A window's minimiser is the least hash of its ``GRAM``-word grams; equal windows have equal minimisers, and
neighbouring windows mostly share one. A maximal run of windows with one minimiser is a super-k-mer.

1. Every text gives its super-k-mers as narrow rows (minimiser, document, first window, windows). No text moves.
2. Minimisers are counted with map-side combining; those met at one place cannot hold a repeated
   window and go.
3. The remaining super-k-mers are cut from their texts and travel as packed strings to their minimiser's bucket.
   A minimiser with more than ``BUCKET_ROWS`` of them gets several buckets, dealt by position.
4. Each bucket sorts its windows; windows met twice, by all their words' bytes, are repeats. Split buckets also hand
   out one row per distinct window with a cryptographic digest, and those met in two buckets of a minimiser are
   repeats as well.
5. Covered word ranges go back to their documents, which keep the other words.

Null text has no words. Each row is a document of its own: rows equal in id and text (or both without an id) repeat
each other, and lose all words if they have a window. Documents of fewer words than a window keep all. An empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import rows_of, saved, small_side, text_or_empty, workspace
from pagewright.llm.wordscan import Texts, grams, inside, mix, row_index, slices, span_ids

WINDOW, GRAM = 35, 8
#: Windows in one super-k-mer at most, super-k-mers in one bucket about at most.
RUN_WINDOWS, BUCKET_ROWS = 256, 1024
#: Bytes of ranges up to which they are broadcast to the texts; they grow with the corpus, so beyond little ones both move.
RANGES_BYTES = 4 << 20
#: End of a range that covers a whole document.
ALL = 2**31 - 1
CHUNK_BYTES = 4 << 20
U = np.uint64
PLACE_BITS = U(30)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` values in a row: block-wise running minima from both sides."""
    if len(x) < n:
        return x[:0]
    pad = (-len(x)) % n
    blocks = np.append(x, np.full(pad, ~U(0))).reshape(-1, n)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: len(x) - n + 1], left[n - 1 : len(x)])


def super_kmers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, row, first window (in the row), number of windows, and weight of every super-k-mer.

    The weight is 2 if the minimiser stands at several places of the run, whose windows may then equal each other.
    """
    t = Texts(arr)
    starts, ends, off = t.words()
    g = grams(t.hashes(starts, ends), GRAM)
    # Upper bits of the hash, then the place: the least one is the leftmost of the least grams.
    spot = sliding_min((g >> PLACE_BITS << PLACE_BITS) + np.arange(len(g), dtype=U), WINDOW - GRAM + 1)
    at = np.flatnonzero(inside(off, WINDOW))
    if not len(at):
        return np.zeros(0, U), at, at, at, at
    spot = (spot[at] & ((U(1) << PLACE_BITS) - U(1))).astype(np.int64)
    least, row = g[spot], row_index(off)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    weight = 1 + (spot[first] != spot[first + count - 1])
    if count.max() > RUN_WINDOWS:  # long runs are cut into equal parts
        cut = -(-count // RUN_WINDOWS)
        part = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        weight = np.repeat(weight, cut)
        first, count = np.repeat(first, cut) + part * RUN_WINDOWS, np.minimum(RUN_WINDOWS, np.repeat(count, cut) - part * RUN_WINDOWS)
    return least[first], row[first], at[first] - off[row[first]], count, weight


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the two columns that tell documents apart."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("did"), F.xxhash64(F.col("doc_id").isNull(), text_or_empty()).alias("rid"))


def find_super_kmers(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                mini, row, start, count, weight = super_kmers(part.column("text"))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini.view(np.int64)), part.column("did").take(take), part.column("rid").take(take), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(weight.astype(np.int32))],
                    ["mini", "did", "rid", "start", "n", "weight"],
                )

    return keyed(docs).select("did", "rid", "text").mapInArrow(run, "mini bigint, did bigint, rid bigint, start int, n int, weight int")


def cut_out(placed: DataFrame) -> DataFrame:
    """From did, rid, text and ``runs`` (mini, start, n, buckets), one row per run with its words as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = batch.column("text")[i].as_py().encode().split()
                runs = batch.column("runs").slice(i, 1).flatten()
                start, n = (runs.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
                packed = [b" ".join(w[s : s + k + WINDOW - 1]).decode() for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                same = lambda name: pa.array(np.full(len(start), batch.column(name)[i].as_py(), np.int64))  # noqa: E731, B023
                buckets = runs.field("buckets").to_numpy(zero_copy_only=False).astype(np.int64)
                bucket = (mix(np.full(len(start), batch.column("rid")[i].as_py() & (2**64 - 1), U) + start.astype(U)) >> U(33)).astype(np.int64) % buckets
                yield pa.RecordBatch.from_arrays(
                    [runs.field("mini"), pa.array(bucket), pa.array(buckets), same("did"), same("rid"), pa.array(start.astype(np.int32)), pa.array(packed, pa.string())],
                    ["mini", "bucket", "buckets", "did", "rid", "start", "packed"],
                )

    return placed.mapInArrow(run, "mini bigint, bucket bigint, buckets bigint, did bigint, rid bigint, start int, packed string")


FOUND = "kind int, mini bigint, d1 bigint, d2 bigint, did bigint, rid bigint, lo int, hi int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
RANGE, ONCE, OFTEN = 0, 1, 2


def count_windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Repeats among whole buckets, sorted by bucket and place: RANGE rows with word ranges to remove.

    For split buckets also one row per distinct window: ONCE with its place, or OFTEN.
    """
    mini, bucket, buckets, did, rid, start = (rows.column(c).to_numpy() for c in ("mini", "bucket", "buckets", "did", "rid", "start"))
    own = np.ones(len(mini), bool)  # rows met twice are one
    own[1:] = (np.diff(mini) != 0) | (np.diff(bucket) != 0) | (np.diff(did) != 0) | (np.diff(rid) != 0) | (np.diff(start) != 0)
    if not own.all():
        yield from count_windows(rows.filter(pa.array(own)))
        return
    t = Texts(rows.column("packed").combine_chunks())
    s, e, off = t.words()
    at = np.flatnonzero(inside(off, WINDOW))
    if not len(at):
        return
    word = span_ids(t, s, e)
    row = row_index(off)[at]
    group = np.cumsum(np.concatenate([[0], (np.diff(mini) != 0) | (np.diff(bucket) != 0)]))
    key = grams(mix(word.astype(U) + U(1)), WINDOW)[at] ^ mix(group[row].astype(U) + U(1))
    order = np.argsort(key)
    ordered, place = key[order], at[order]
    again = ordered[1:] == ordered[:-1]
    pairs = np.flatnonzero(again)
    for d in range(WINDOW):  # equal hashes count only if all words are the same
        again[pairs] &= word[place[pairs] + d] == word[place[pairs + 1] + d]
    twice = np.zeros(len(order), bool)
    twice[1:] |= again
    twice[:-1] |= again
    hot = np.zeros(len(order), bool)
    hot[order] = twice
    # Neighbouring repeated windows of a row are one range of words.
    i = np.flatnonzero(hot)
    if len(i):
        new = np.ones(len(i), bool)
        new[1:] = (row[i][1:] != row[i][:-1]) | (np.diff(i) != 1)
        first, last = i[new], i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
        r = row[first]
        lo = start[r] + at[first] - off[r]
        hi = start[r] + at[last] - off[r] + WINDOW
        yield found(np.full(len(r), RANGE), mini[r], np.zeros(len(r), U), np.zeros(len(r), U), did[r], rid[r], lo, hi)
    head = order[np.concatenate([[True], ~again])]
    head = head[buckets[row[head]] > 1]
    if len(head):
        r = row[head]
        lo = start[r] + at[head] - off[r]
        spans = zip(s[at[head]].tolist(), e[at[head] + WINDOW - 1].tolist(), strict=True)  # packed words stand one space apart
        data = t.bytes.tobytes()
        digest = np.frombuffer(b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans), U).reshape(-1, 2)
        yield found(np.where(hot[head], OFTEN, ONCE), mini[r], digest[:, 0].copy(), digest[:, 1].copy(), did[r], rid[r], lo, lo + WINDOW)


def found(kind, mini, d1, d2, did, rid, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), pa.array(mini), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(did), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], FOUND_NAMES
    )


def sort_buckets(packed: DataFrame) -> DataFrame:
    """``count_windows`` over every bucket; a task holds a few megabytes, and whole buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "packed", CHUNK_BYTES):
                held.append(part)
                size += part.nbytes
                if size < CHUNK_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                mini, bucket = (table.column(c).to_numpy() for c in ("mini", "bucket"))
                breaks = np.flatnonzero((np.diff(mini) != 0) | (np.diff(bucket) != 0))
                if len(breaks):
                    done = int(breaks[-1]) + 1
                    yield from count_windows(table.slice(0, done).combine_chunks())
                    held = table.slice(done).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from count_windows(pa.Table.from_batches(held).combine_chunks())

    return packed.repartition("mini", "bucket").sortWithinPartitions("mini", "bucket", "did", "rid", "start").mapInArrow(run, FOUND)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """did, rid, lo, hi: ranges of words that repeated windows cover."""
    runs = find_super_kmers(docs)  # found twice: that costs less than keeping every run on disk
    often = runs.groupBy("mini").agg(F.sum("weight").alias("c")).where("c > 1")
    shared = saved(runs.join(often, "mini").select("did", "rid", F.struct("mini", "start", "n", F.ceil(F.col("c") / BUCKET_ROWS).cast("int").alias("buckets")).alias("run")))
    touched = small_side(saved(shared.select("did", "rid").distinct(), rows=rows_of(shared)))
    texts = keyed(docs).select("did", "rid", "text").join(touched, ["did", "rid"], "left_semi").dropDuplicates(["did", "rid"])
    by_doc = shared.groupBy("did", "rid").agg(F.collect_set("run").alias("runs"))  # rows alike bring the same runs
    # Texts lie by document once they are told apart, so they meet their runs without being written or moved again.
    hits = saved(sort_buckets(cut_out(texts.join(by_doc, ["did", "rid"]).select("did", "rid", "text", "runs"))))
    split = hits.where(f"kind != {RANGE}")
    across = split.groupBy("mini", "d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("mini", "d1", "d2")
    late = split.where(f"kind = {ONCE}").join(across, ["mini", "d1", "d2"])
    cols = ["did", "rid", "lo", "hi"]
    copies = keyed(docs).groupBy("did", "rid").agg(F.count("*").alias("c")).where("c > 1")
    return hits.where(f"kind = {RANGE}").select(cols).union(late.select(cols)).union(copies.select("did", "rid", F.lit(0).alias("lo"), F.lit(ALL).alias("hi")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and ``kept``, the remaining words."""
    with workspace(docs.sparkSession) as keep:
        ranges = saved(repeated_ranges(docs).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
        keep.append(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                total, gone, sha, kept = [], [], [], []
                for text, cuts in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    w = (text or "").encode().split()
                    total.append(len(w))
                    if cuts and len(w) >= WINDOW:
                        keep = np.ones(len(w), bool)
                        for c in cuts:
                            keep[c["lo"] : c["hi"]] = False
                        w = [w[i] for i in np.flatnonzero(keep).tolist()]
                    gone.append(total[-1] - len(w))
                    joined = b" ".join(w)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    kept.append(joined.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    both = keyed(docs).join(small_side(ranges, RANGES_BYTES), ["did", "rid"], "left").select(F.col("doc_id").cast("long"), "text", "ranges")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
