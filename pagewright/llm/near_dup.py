"""Near duplicates: BagMinHash signatures, banding, exact multiset overlap, connected classes.

A text is the multiset of its five-word shingles (all its words, if fewer than five). Similarity is the weighted
Jaccard of two multisets; texts of 0.8 or more are linked, and classes are what links connect.

Work and data movement:

* identical texts meet first, on 128 bits of a hash of the text, with map-side combining, so a huge group of copies is
  one node; from then on nodes are texts, not ids, and have a number of their own;
* signatures need no shuffle; bands move as (key, node) pairs, and only keys with two nodes or more go on;
* in each bucket every node is compared with the bucket's lowest node only. In buckets that still hold several
  classes, nodes are dropped whose shingles are their own by more than a similarity of 0.8 allows (exact, from
  counts of shingles), and the rest is compared with the bucket's most typical node. Then a centre is made of that
  node: linked nodes that are still in different classes differ from it in the same places (``meetings``), so only
  nodes that meet on such a place are paired, no bucket with itself. So no link between classes that share a bucket is
  lost, while the pairs inside a class are never spelled out;
* texts of candidates move once. They meet their pairs by broadcast where their measured bytes allow it; beyond, a pair
  is dealt to a place of its node with more partners, to which that node's text goes once and the other's with the
  pair; a node met by many has up to ``SLOTS`` places, so it is not one task's;
* every step works on classes found so far: the later ones join whole classes, not nodes.

Signatures miss a pair of exactly 0.8 with chance (1 - 0.8**ROWS)**BANDS, about 6e-5, and closer pairs less.

Null text counts as empty; texts without words are linked to identical texts only. A class is named by its lowest
doc_id, which is null if all its ids are, and kept in the document of that id. An id that stands for different texts
links nothing: each of its rows belongs to its text's class, and names it only if no other id does; then the row of the
least text hash is kept, and two classes may bear one name. Rows equal in id and text are alike. An empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import free_name, is_small, rows_of, saved, small_side, text_hash, text_or_empty, workspace
from pagewright.llm.wordscan import Texts, grams, inside, mix, row_index, slices

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
POINTS_MARGIN = 4.6
#: Most places that the pairs of one node are dealt to, by their other node, and about how many pairs a place is for.
SLOTS, PARTNERS = 256, 16
#: Longs of a node's parities of differences, and about how many nodes choose the centre of a bucket.
PARITIES, VOTERS = 4, 32
#: Bytes of candidates' texts up to which they are broadcast to their pairs.
TEXT_BYTES = 16 << 20
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def shingles(t: Texts, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and its row; rows of fewer words than ``n`` have one of all their words."""
    starts, ends, off = t.words()
    h = t.hashes(starts, ends)
    row = row_index(off)
    at = np.flatnonzero(inside(off, n))
    found, where = [grams(h, n)[at]], [row[at]]
    count = np.diff(off)
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            found.append(grams(h, k)[off[short]])
            where.append(short)
    return np.concatenate(found), np.concatenate(where)


def multisets(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with multiplicities: hash, row, count."""
    keys = mix(hashes ^ mix(row.astype(U) + U(1)))
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, int)
    count = np.diff(np.append(first, len(keys)))
    return hashes[order[first]], row[order[first]], count


def bag_signatures(hashes: np.ndarray, row: np.ndarray, count: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """BagMinHash of integer weights: ``k`` values a row, equal at each place with chance of weighted Jaccard.

    The weight axis of a shingle is cut at 0, 1, 2, 4, 8, ...; each block has one Poisson process with its length
    as rate, seeded by shingle and block. A point has a time, a place in its block and one of the ``k`` registers;
    it belongs to a weight above its place. A register keeps its earliest point. Blocks wholly above a weight are
    never opened, and times beyond which all registers are filled are never drawn.
    """
    sig = np.zeros((n_rows, k), U)
    total = np.bincount(row, weights=count, minlength=n_rows)
    todo = np.flatnonzero(total > 0)
    horizon = k * (np.log(k) + POINTS_MARGIN) / np.maximum(total, 1)
    levels = int(count.max()).bit_length() if len(count) else 0
    lows = [0, *[1 << b for b in range(levels)]]
    parts = []
    for b, low in enumerate(lows):
        some = np.flatnonzero(count > low)
        if len(some):
            parts.append((mix(hashes[some] + np.full(1, b, U) * GOLD), row[some], count[some], np.full(len(some), low), np.full(len(some), float(max(low, 1)))))
    if not parts:
        return sig
    seed, owner, weight, low, rate = (np.concatenate(x) for x in zip(*parts, strict=True))
    while len(todo):
        best = np.full(n_rows * k, np.inf)
        live = np.isin(owner, todo) if len(todo) < n_rows else np.ones(len(owner), bool)
        s, o, w, lo, r = seed[live], owner[live], weight[live], low[live], rate[live]
        time, draw = np.zeros(len(s)), 0
        points = []
        while len(s):
            draw += 1
            z = mix(s + np.full(1, draw, U) * GOLD)
            time = time - np.log(((z >> U(11)).astype(float) + 0.5) * 2.0**-53) / r
            near = time <= horizon[o]
            s, o, w, lo, r, time, z = s[near], o[near], w[near], lo[near], r[near], time[near], z[near]
            mark = mix(z ^ GOLD)
            slot = o * k + ((mark >> U(32)) * U(k) >> U(32)).astype(np.int64)
            held = lo + (mark & U(0xFFFFFFFF)).astype(float) * 2.0**-32 * r < w
            points.append((slot[held], time[held], mark[held]))
        slot, time, mark = (np.concatenate(x) for x in zip(*points, strict=True))
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        flat = sig.reshape(-1)
        flat[slot[won]] = mark[won]
        empty = np.isinf(best).reshape(n_rows, k).any(1)
        todo = todo[empty[todo]]
        horizon[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    out = np.zeros((len(sig), bands), U)
    for j in range(rows):
        out = mix(out * GOLD + sig[:, j::rows][:, :bands])
    return mix(out + np.arange(1, bands + 1, dtype=U) * GOLD)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h (hash of the text), size (number of shingles), keys (band keys; empty without words)."""
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                found, row = shingles(Texts(part.column("text")))
                size = np.bincount(row, minlength=part.num_rows)
                keys = band_keys(bag_signatures(*multisets(found, row), part.num_rows, k), bands, rows).view(np.int64)
                full = size > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(size.astype(np.int64)), lists], ["doc_id", "h", "size", "keys"])

    source = docs.select(F.col("doc_id").cast("long"), text_hash().alias("h"), "text")
    return source.mapInArrow(run, "doc_id bigint, h binary, size bigint, keys array<bigint>")


def overlaps(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles and weighted Jaccard of each pair of texts, from exact multisets; 0 where neither has words."""
    n = len(texts_a)
    sides, sizes = [], np.zeros(n)
    for arr in (texts_a, texts_b):
        found, row = shingles(Texts(arr))
        sizes += np.bincount(row, minlength=n)
        h, r, c = multisets(found, row)
        sides.append((mix(h ^ mix(r.astype(U) + U(1))), r, c))
    (ka, ra, ca), (kb, _, cb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount(ra[ia], weights=np.minimum(ca[ia], cb[ib]), minlength=n)
    return shared.astype(np.int64), shared / np.maximum(sizes - shared, 1)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b: nodes, and more; a saved table) with text_a and text_b. ``texts`` (node, text) is a saved table."""
    if is_small(texts, TEXT_BYTES):
        tasks = max(1, min(4 * pairs.sparkSession.sparkContext.defaultParallelism, rows_of(pairs) // 256))
        left, right = (F.broadcast(texts.toDF(side, f"text_{side}")) for side in "ab")
        return pairs.repartition(tasks).join(left, "a").join(right, "b")
    many = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    many = saved(many.where(F.col("n") > PARTNERS))
    dealt, turned, slots = pairs, F.lit(False), F.lit(1)
    if rows_of(many):
        for side in "ab":
            dealt = dealt.join(small_side(many.toDF(side, f"n_{side}"), size_of=many), side, "left")
        n_a, n_b = (F.coalesce(f"n_{side}", F.lit(0)) for side in "ab")
        turned, slots = n_b > n_a, F.least(F.lit(SLOTS), F.ceil(F.greatest(n_a, n_b, F.lit(1)) / PARTNERS))
    hub, other = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    dealt = dealt.select(*pairs.columns, turned.alias("turned"), hub.alias("hub"), other.alias("other"), F.pmod(F.xxhash64(other), slots).alias("slot"))
    places = saved(dealt.select(F.col("hub").alias("node"), "slot").distinct(), 2 * rows_of(pairs))
    at_hub = texts.join(small_side(places), "node").select(F.col("node").alias("hub"), "slot", F.col("text").alias("text_hub"))
    others = texts.toDF("other", "text_other")
    if is_small(pairs):
        others = others.join(F.broadcast(dealt), "other")
    else:
        needed = saved(dealt.select("other").distinct(), rows_of(pairs))
        others = others.join(small_side(needed), "other", "left_semi").join(dealt, "other")
    both = others.join(at_hub, ["hub", "slot"])
    text_a, text_b = (F.when(F.col("turned") == flag, F.col("text_other")).otherwise(F.col("text_hub")) for flag in (True, False))
    return both.select(*pairs.columns, text_a.alias("text_a"), text_b.alias("text_b"))


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ra, rb: nodes and their classes; a saved table), and whether they are linked. ``texts`` (node,
    text) is a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                _, close = overlaps(part.column("text_a"), part.column("text_b"))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(close >= SIMILARITY)], ["a", "b", "ra", "rb", "linked"])

    both = with_texts(pairs, texts).select("a", "b", "ra", "rb", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, b bigint, ra bigint, rb bigint, linked boolean")


def each_shingle(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, the second of a kind told apart from the first, and their rows."""
    h, row, count = multisets(*shingles(Texts(texts)))
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(h, count) + rank.astype(U) * GOLD), np.repeat(row, count)


def own_shingles(texts: DataFrame) -> DataFrame:
    """node, own: those of its shingles (the second of a kind told apart from the first) that no other node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                each, row = each_shingle(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(row)), pa.array(each.view(np.int64))], ["node", "shingle"])

    held = texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return held.where("n = 1").groupBy("node").agg(F.collect_list("shingle").alias("own"))


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Where nodes b differ from the centre of a: the shingles of a, but for those in ``usual``, of which the centre has
    just those that a has not.

    ``pairs`` (a, b, root: b's class, own: shingles that only b has, usual; a saved table); ``texts`` as in ``measured``.
    Gives a, node, root, size, d (places, which are shingles of just one of node and centre), places (those that are not
    the node's own, in one order for all), and bits (parities of these places: two nodes differ in as many places as
    their bits do, or more).
    """
    bits = [f"bits{k}" for k in range(PARITIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                rows = part.num_rows
                keyed = lambda x, row: mix(x ^ mix(row.astype(U) + U(1)))
                count = lambda row: np.bincount(row, minlength=rows)

                def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
                    lengths = part.column(name).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023
                    return part.column(name).flatten().to_numpy().view(U), np.repeat(np.arange(rows), lengths)  # noqa: B023

                (there, row_a), (here, row_b), (own, row_own), (usual, row_usual) = each_shingle(part.column("text_a")), each_shingle(part.column("text_b")), lists("own"), lists("usual")
                key_a, key_usual, key_b = keyed(there, row_a), keyed(usual, row_usual), keyed(here, row_b)
                left, more = ~np.isin(key_a, key_usual), ~np.isin(key_usual, key_a)
                there, row_a, key_a = (np.concatenate([x[left], y[more]]) for x, y in ((there, usual), (row_a, row_usual), (key_a, key_usual)))
                missing, extra = ~np.isin(key_a, key_b), ~np.isin(key_b, key_a)
                d = count(row_a[missing]) + count(row_b[extra])
                extra &= ~np.isin(key_b, keyed(own, row_own))
                # Shingles that the centre has not come first: they are the rarer ones.
                place, row = np.concatenate([here[extra], there[missing]]), np.concatenate([row_b[extra], row_a[missing]])
                order = np.lexsort((place, np.arange(len(row)) >= extra.sum(), row))
                place, row = place[order], row[order]
                odd = np.zeros((rows, 64 * PARITIES), np.uint8)
                np.bitwise_xor.at(odd, (row, (mix(place) % U(64 * PARITIES)).astype(np.int64)), 1)
                parity = np.packbits(odd, axis=1).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(count(row))]).astype(np.int32)
                made = [pa.array(count(row_b)), pa.array(d), pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.view(np.int64))), *(pa.array(np.ascontiguousarray(x)) for x in parity.T)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "root")), *made], ["a", "node", "root", "size", "d", "places", *bits])

    both = with_texts(pairs, texts).select("a", "b", "root", "own", "usual", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, node bigint, root bigint, size bigint, d bigint, places array<bigint>, " + ", ".join(f"{c} bigint" for c in bits))


def centred(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``differences`` of ``pairs`` (a, b, root, own; a saved table) from a centre that has what most nodes have: the
    fewer the places, the fewer the meetings. Some nodes choose it; whatever it is, no link is lost. A saved table."""
    several = small_side(saved(pairs.groupBy("a").agg(F.count("*").alias("n"))))
    voters = pairs.join(several, "a").where(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / VOTERS)) == 0)
    voters = saved(voters.select("a", "b", "root", "own", F.array().cast("array<bigint>").alias("usual")))
    all_votes = small_side(saved(voters.groupBy("a").agg(F.count("*").alias("all"))))
    votes = differences(voters, texts).select("a", F.explode("places").alias("place")).groupBy("a", "place").agg(F.count("*").alias("votes"))
    usual = saved(votes.join(all_votes, "a").where("2 * votes > all").groupBy("a").agg(F.collect_list("place").alias("usual")))
    return saved(differences(saved(pairs.join(small_side(usual), "a", "left")), texts), sized=False)


def meetings(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``differences`` (a saved table): links (a, b) that are certain, and the pairs (a, b, ra, rb) of different
    classes that may be linked, but for those that the certain links join.

    Nodes x and y with c places in common are linked if and only if 18 c >= g(x) + g(y), where g is 9 d - size. So each
    node with g(x) <= -g(y) is linked to the y of the least g, and if any two nodes are linked without a common place,
    both are linked to that one. Of two others at least one, x, is ``free``: it has g(x) > -least. As g(y) >= least, both
    need common places: 18 c >= g(x) + least and 18 c > g(y) - least. Of n places of a node (its own ones can't be
    common) the first common one is among the first n - c + 1.
    """
    g = 9 * F.col("d") - F.col("size")
    least = saved(apart.groupBy("a").agg(F.min(F.struct(g.alias("g"), "node", "root")).alias("least")))
    apart = apart.withColumn("g", g).join(small_side(least), "a").withColumn("free", F.col("g") + F.col("least.g") > 0)
    certain = apart.where("not free and root != least.root").select(F.col("least.root").alias("a"), F.col("root").alias("b")).distinct()

    n = F.size("places")
    some = apart.withColumn("n", n).withColumn("root", F.when(F.col("free"), F.col("root")).otherwise(F.col("least.root")))
    some = some.withColumn("alone", F.col("d") - n).withColumn("met", n - F.ceil((F.col("g") - F.col("least.g") + 1) / 18) + 1)
    some = some.withColumn("reach", F.when(F.col("free"), n - F.ceil((F.col("g") + F.col("least.g")) / 18) + 1).otherwise(F.col("met")))
    kept = ["a", "node", "root", "size", "g", "n", "alone", "free", "met", *[f"bits{k}" for k in range(PARITIES)]]
    places = saved(some.where("reach > 0").select(*kept, F.posexplode(F.slice("places", 1, F.col("reach").cast("int"))).alias("at", "place")), sized=False)
    left, right = (places.toDF(*[c if c in ("a", "place") else f"{c}_{side}" for c in places.columns]) for side in "xy")
    differ = sum((F.bit_count(F.col(f"bits{k}_x").bitwiseXOR(F.col(f"bits{k}_y"))) for k in range(PARITIES)), F.col("alone_x") + F.col("alone_y"))
    # If this is the first place in common, so many are at most.
    common = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    able = (9 * differ <= F.col("size_x") + F.col("size_y")) & (F.col("g_x") + F.col("g_y") <= 18 * common)
    once = ~F.col("free_y") | (F.col("node_x") < F.col("node_y"))
    both = left.where("free_x").join(right.where("at_y < met_y"), ["a", "place"]).where((F.col("root_x") != F.col("root_y")) & once & able)
    return certain, both.select(F.col("node_x").alias("a"), F.col("node_y").alias("b"), F.col("root_x").alias("ra"), F.col("root_y").alias("rb")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for nodes with an edge (a, b); one root for each connected component.

    Each round hooks every node to the first of itself and its neighbours, in an order shuffled for the round, and joins
    the edges' ends to that: the last node of a component goes at least, and a constant share of the nodes as a rule.
    A hub costs nothing extra: minima are combined before they move.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    labels, turn = None, 0
    while n := rows_of(now):
        turn += 1
        order = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731, B023  a bijection of longs
        up = now.union(now.select("v", "u")).groupBy("u").agg(F.min_by("v", order("v")).alias("m"))
        up = saved(up.select("u", F.when(order("u") < order("m"), F.col("u")).otherwise(F.col("m")).alias("m")), 2 * n)
        to = lambda end, name: small_side(up.toDF(end, name), size_of=up)  # noqa: E731, B023
        moved = now.join(to("u", "a"), "u").join(to("v", "b"), "v").where("a != b")
        now = saved(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n)
        if labels is None:
            labels = up
        else:
            labels = labels.join(to("m", "next"), "m", "left").select("u", F.coalesce("next", "m").alias("m"))
    return saved((now if labels is None else labels).toDF("node", "root"))


def close_sizes(a: str, b: str) -> Column:
    """Texts reach the similarity only if the smaller has that share of the larger's shingles."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def placed(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column``, a node or class, replaced by its root in ``roots``, if it has one."""
    at = small_side(roots.toDF(column, "_root"), size_of=roots)
    return rows.join(at, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def mixed(rows: DataFrame, more_than: int = 1) -> DataFrame:
    """The rows of keys that hold several classes and more than so many nodes."""
    several = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("n"))
    return saved(rows.join(small_side(saved(several.where(f"r1 != r2 and n > {more_than}").select("key"))), "key", "left_semi"))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("linked and ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def ambiguous_ids(sig: DataFrame) -> DataFrame:
    """The doc_ids that stand for different texts, as a saved table."""
    hashed = F.xxhash64("h")
    ids = sig.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("h1"), F.max(hashed).alias("h2"))
    return saved(ids.where("h1 != h2").select("doc_id"))


def named_nodes(sig: DataFrame) -> DataFrame:
    """A row for each text, with the doc_id that stands for it: the lowest of those with one text, or else the lowest."""
    several = ambiguous_ids(sig)
    clear = F.col("doc_id")
    if rows_of(several):
        sig = sig.join(small_side(several.select("doc_id", F.lit(True).alias("several"))), "doc_id", "left")
        clear = F.when(F.col("several").isNull(), F.col("doc_id"))
    nodes = sig.groupBy("h").agg(F.count("*").alias("copies"), F.min(clear).alias("clear"), F.min("doc_id").alias("any"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    named = nodes.select("h", "copies", F.coalesce("clear", "any").alias("doc"), F.col("clear").isNull().alias("unclear"), "size", "keys")
    return saved(named.withColumn("node", F.monotonically_increasing_id()))


def rest_of(members: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Roots of the links that comparing with the lowest node left out, to be applied in turn: classes of classes.

    ``members``: key, node, size, root (the class so far)."""
    some = mixed(members, 2)  # of two, one was compared with the other
    if not rows_of(some):
        return []
    own = saved(own_shingles(texts.join(small_side(some.select("node"), size_of=some), "node", "left_semi")))
    able = some.join(small_side(own), "node", "left").withColumn("common", F.col("size") - F.coalesce(F.size("own"), F.lit(0))).drop("own").where(F.col("common") >= SIMILARITY * F.col("size"))
    typical = able.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.struct((F.col("size") - F.col("common")).alias("own"), "node", "root")).alias("t"))
    typical = saved(typical.where("r1 != r2").select("key", F.col("t.node").alias("t"), F.col("t.root").alias("t_root")))
    if not rows_of(typical):
        return []
    held = saved(able.join(small_side(typical), "key"))
    pairs = saved(held.where("node != t").select(F.col("t").alias("a"), F.col("node").alias("b"), F.col("t_root").alias("ra"), F.col("root").alias("rb")).distinct())
    star = saved(measured(pairs, texts))
    roots = components(linked(star))

    some = mixed(placed(held.where("node != t").select("key", "t", "node", "root"), roots, "root"))
    if not rows_of(some):
        return [roots]
    against = some.select(F.col("t").alias("a"), F.col("node").alias("b"), "root").distinct()
    against = saved(against.join(small_side(own.toDF("b", "own"), size_of=own), "b", "left"))
    certain, pairs = meetings(centred(against, texts))
    pairs = saved(pairs)
    return [roots, components(certain.union(linked(measured(pairs, texts))) if rows_of(pairs) else certain)]


def classified(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, as a saved table: doc_id, h (hash of the text), class_id and kept."""
    with workspace(docs.sparkSession) as keep:
        sig = saved(signatures(docs))
        nodes = named_nodes(sig)
        exploded = nodes.select("node", "size", F.explode("keys").alias("key"))
        shared = saved(exploded.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("low")).where("n > 1").select("key", F.col("low.node").alias("low"), F.col("low.size").alias("low_size")))
        members = saved(exploded.join(small_side(shared), "key"))
        met = saved(nodes.select("h", "doc", "node").join(small_side(saved(members.select("node").distinct())), "node", "left_semi"))
        # One row of each text, or the rows alike in id and text.
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), text_or_empty().alias("text"))
        there = own.join(small_side(met.withColumnRenamed("h", "of"), size_of=met), (F.col("h") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("doc")))
        texts = saved(there.groupBy("node").agg(F.first("text").alias("text")))

        pairs = members.where("node > low").where(close_sizes("size", "low_size")).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
        star = measured(saved(pairs.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"))), texts)
        roots = [components(linked(star))]
        roots += rest_of(placed(members.select("key", "node", "size", F.col("node").alias("root")), roots[0], "root"), texts)

        named = nodes.select("h", "copies", "doc", "unclear", F.col("node").alias("root"))
        for r in roots:
            named = placed(named, r, "root")
        named = saved(named)
        best = named.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc").isNull().alias("none"), "unclear", "doc", "h")).alias("best")).where("n > 1")
        best = saved(best.select("root", F.col("best.doc").alias("class_id"), F.col("best.h").alias("at")))
        # Rows without copies or links stand for themselves and need not be looked up.
        found = named.join(small_side(best), "root", "left").where("copies > 1 or at is not null")
        found = saved(found.select("h", F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("at", "h").alias("at"), F.lit(True).alias("found")))
        out = sig.select("doc_id", "h").join(small_side(found), "h", "left")
        kept = F.when(F.col("found"), (F.col("at") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).otherwise(True)
        out = saved(out.select("doc_id", "h", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), kept.alias("kept")))
        keep.append(out)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (lowest doc_id of its class), kept (true for that document)."""
    return classified(docs).select("doc_id", "class_id", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one for each. Ids and text hashes are looked up; texts stay
    where they are unless more go than a broadcast may hold, or rows are alike in id and text."""
    judged = classified(docs)
    gone = saved(judged.where("not kept").select("doc_id", "h").distinct())
    again = saved(judged.where("kept").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "h"))
    h = free_name(docs)
    own = docs.withColumn(h, text_hash())

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        at = small_side(keys.toDF("_id", "_of"), size_of=keys)
        return rows.join(at, (rows[h] == at["_of"]) & rows["doc_id"].cast("long").eqNullSafe(at["_id"]), how)

    left = among(own, gone, "left_anti")
    if rows_of(again):
        left = among(left, again, "left_anti").unionByName(among(left, again, "left_semi").dropDuplicates(["doc_id", h]))
    return left.drop(h)
