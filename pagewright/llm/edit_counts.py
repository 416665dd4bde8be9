"""Edit-aware token counts: a segment tree over a document's pre-token leaves, updated where edits touch it.

Leaves are runs of at least ``LEAF_CHARS`` characters, cut at ends of tokens where the ids of both sides add up to those
of the whole (see ``tokens.cuts``): between pre-tokens, and inside a long one (a run of letters without blanks, as in
Chinese, or of blanks) where no merge crosses. So leaves are short whatever the text: in words, lines or tabs, in no
script more than a token beyond the size. An edit re-encodes the leaves it touches together with one neighbour on each
side. If the places between them and the neighbours are cuts in the new text as well, all else keeps its ids, since it
merges as it did; if one is not, the leaves beyond it are taken in, twice as many each time. (In a long run of one sign
an edit may shift how all signs after it pair up; then they are encoded again, as they must be.) The pieces become leaves:
within their number sums change on the paths above; where more come, or half of the leaves are empty, the tree is laid
out anew over the counts it has, and nothing else is encoded. So leaves stay small however much is inserted.

Trees are rows of a table: ``build_trees`` makes them, ``apply_edits`` takes them with edits and hands them on as they
are afterwards, to be edited again. One narrow pass each, no shuffle. Null text counts as empty; null edits are none.
Edits apply in their order, each on the text the former left; places beyond the end mean the end, negative ones the
start, negative lengths nothing. Repeated rows are alike; an empty table gives an empty result; clashing further columns
are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import saved, text_or_empty
from pagewright.llm.tokens import cuts

LEAF_CHARS = 128


def split_leaves(text: str) -> tuple[list[str], list[int]]:
    """Leaves of a text, and how many ids each has."""
    at, before, total = cuts(text)
    return pieces(text, 0, len(text), at, before, 0, total)


def pieces(text: str, lo: int, hi: int, at: np.ndarray, before: np.ndarray, ids_lo: int, ids_hi: int) -> tuple[list[str], list[int]]:
    """The stretch from ``lo`` to ``hi`` as leaves with their ids, from the cuts of ``text`` and the ids before both ends."""
    out, ids = [], []
    if hi - lo >= 2 * LEAF_CHARS:
        at, before = at.tolist(), before.tolist()
    while hi - lo >= 2 * LEAF_CHARS:
        k = bisect_left(at, lo + LEAF_CHARS)
        if k == len(at) or at[k] >= hi:
            break
        out.append(text[lo : at[k]])
        ids.append(before[k] - ids_lo)
        lo, ids_lo = at[k], before[k]
    return [*out, text[lo:hi]], [*ids, ids_hi - ids_lo]


class TokenTree:
    """Leaves with a binary tree of (characters, ids) sums; node 1 is the root, leaf i is node width + i."""

    def __init__(self, leaves: list[str], ids: list[int]):
        self.encoded = 0
        self.lay_out(leaves, ids)

    def lay_out(self, leaves: list[str], ids: list[int]) -> None:
        self.leaves = leaves
        self.filled = sum(1 for x in leaves if x)
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(leaves)] = np.stack([[len(x) for x in leaves], ids], axis=1)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def ids(self) -> list[int]:
        """Number of ids of each leaf."""
        return self.sums[self.width : self.width + len(self.leaves), 1].tolist()

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place``, and the place in it; past the end, the end of the last."""
        node = 1
        while node < self.width:
            node *= 2
            if place >= self.sums[node, 0] and self.sums[node + 1, 0]:
                place -= int(self.sums[node, 0])
                node += 1
        return node - self.width, place

    def put(self, leaf: int, text: str, ids: int) -> None:
        self.filled += bool(text) - bool(self.leaves[leaf])
        self.leaves[leaf] = text
        node = self.width + leaf
        self.sums[node] = len(text), ids
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on one side of ``leaf``; None beyond the last."""
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def edit(self, at: int, remove: int, insert: str) -> None:
        size = int(self.sums[1, 0])
        at = min(max(at, 0), size)
        end = min(at + max(remove, 0), size)
        first, inner = self.leaf_at(at)
        lo, hi = first, self.leaf_at(end)[0]
        own = "".join(self.leaves[lo : hi + 1])
        own = own[:inner] + insert + own[inner + end - at :]
        taken = 1  # twice as many leaves each time a cut is lost, so a run of one sign costs its length a few times over
        while True:
            left, right = self.beside(lo, -1), self.beside(hi, 1)
            before = "" if left is None else self.leaves[left]
            after = "" if right is None else self.leaves[right]
            text = before + own + after
            found, ids, total = cuts(text)
            self.encoded += len(text)
            a, b = len(before), len(before) + len(own)
            begins, ends = int(np.searchsorted(found, a)), int(np.searchsorted(found, b))
            if left is not None and (begins == len(found) or found[begins] != a):
                taken, old_lo, lo = 2 * taken, lo, max(0, left - taken + 1)
                own = "".join(self.leaves[lo:old_lo]) + own
            elif right is not None and (ends == len(found) or found[ends] != b):
                taken, old_hi, hi = 2 * taken, hi, min(len(self.leaves) - 1, right + taken - 1)
                own += "".join(self.leaves[old_hi + 1 : hi + 1])
            else:
                break
        new, counts = pieces(text, a, b, found, ids, 0 if left is None else int(ids[begins]), total if right is None else int(ids[ends]))
        room = hi - lo + 1
        if len(new) <= room:
            for k in range(room):
                self.put(lo + k, *((new[k], counts[k]) if k < len(new) else ("", 0)))
        else:
            old = self.ids
            self.lay_out(self.leaves[:lo] + new + self.leaves[hi + 1 :], old[:lo] + counts + old[hi + 1 :])
        if 2 * self.filled < len(self.leaves) - 1:
            kept = [(x, n) for x, n in zip(self.leaves, self.ids, strict=True) if x] or [("", 0)]
            self.lay_out(*map(list, zip(*kept, strict=True)))


def build_trees(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, leaf_chars and leaf_tokens (the tree's leaves), n_tokens, and the columns in ``keep``."""
    kept = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *keep)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, ids = [], []
            for text in batch.column("text"):
                leaves, each = split_leaves(text.as_py())
                chars.append([len(x) for x in leaves])
                ids.append(each)
            extra = [pa.array(chars, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32())), pa.array([sum(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "leaf_chars", "leaf_tokens", "n_tokens"])

    return kept.mapInArrow(run, ", ".join([*fields, "leaf_chars array<int>", "leaf_tokens array<int>", "n_tokens bigint"]))


def apply_edits(trees: DataFrame) -> DataFrame:
    """From trees with ``edits`` (array of at, remove, insert): doc_id, n_tokens before and after, how many characters
    were encoded again, and the new tree (text, leaf_chars, leaf_tokens)."""
    counts = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded", "n_leaves"]
    schema = ", ".join([*[f"{c} bigint" for c in counts], "text string", "leaf_chars array<int>", "leaf_tokens array<int>"])
    kinds = [*[pa.int64()] * len(counts), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, text, chars, ids, edits = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "leaf_chars", "leaf_tokens", "edits"))
                ends = np.cumsum(chars).tolist()
                tree = TokenTree([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], ids)
                before = tree.tokens
                for e in edits or []:
                    tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                out.append((doc_id, before, len(edits or []), tree.tokens, tree.encoded, len(tree.leaves), "".join(tree.leaves), [len(x) for x in tree.leaves], tree.ids))
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [*counts, "text", "leaf_chars", "leaf_tokens"])

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(run, schema)


def routine_edits() -> Column:
    """Three edits a document, placed by its length: a replacement, an insertion, a deletion."""
    n = F.length(text_or_empty())
    edit = lambda at, remove, insert: F.struct(at.cast("int").alias("at"), F.lit(remove).alias("remove"), insert.alias("insert"))
    return F.array(
        edit(F.floor(n / 5), 7, F.concat_ws(" ", F.lit(""), "lang", "source")),
        edit(F.floor(n / 2), 0, F.lit(". As noted above,\n")),
        edit(F.floor(n * 4 / 5), 11, F.lit("")),
    )


def edited_counts(docs: DataFrame) -> DataFrame:
    """Token counts of every document before and after its ``routine_edits``, from a table of kept trees."""
    trees = saved(build_trees(docs.withColumn("edits", routine_edits()), "edits"))
    return apply_edits(trees).drop("text", "leaf_chars", "leaf_tokens")
