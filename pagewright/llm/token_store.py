"""Training-order materialisation: fixed-length id sequences, each at its own global slot, in fixed-stride shards.

1. Tasks encode their documents; the ids, two bytes each, are written once.
2. Narrow rows (doc_id, text hash, count) are sorted by range; counts of ids per range give every document its place in
   one stream, which has one order whatever the tasks. Places come to the ids by broadcast while they are small, else by
   row. Sequences are the stream's stretches between multiples of ``LENGTH``, so the same rows make the same sequences on
   any cluster. A keyed Feistel permutation of the next power of two, walked
   until it falls below the number of sequences, turns their numbers into slots: a bijection, computed row by row.
3. Stretches move once, to the task of their slot range; those that two tasks hold parts of are put together there.

Slot s is record s mod ``SHARD`` of shard s div ``SHARD``. A record is the number of its ids that count, the ids, and a
closing line feed: ``stride(length)`` bytes, always, so a reader resumes anywhere by multiplication. Numbers are
little-endian unsigned 16-bit, ids padded with the end id; an id beyond 16 bits is an error. ``write_shards`` writes the
shards and a manifest (records, key, length, shard, stride); ``read_from`` reads the records from any slot on.

Null ids come first. Null text counts as empty: its document is the single end id. Repeated rows are stored as often as
they come, one after the other. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import new_folder, saved, small_side, text_hash, text_or_empty, workspace
from pagewright.llm.tokens import encode
from pagewright.llm.wordscan import mix, slices

LENGTH, END_ID, SHARD = 2048, 50256, 8192
KEY, ROUNDS = 20_240_501, 6
#: Shards that one task writes at most, where there are more shards than shuffle partitions.
TASK_SHARDS = 16
#: How ids are packed where they are encoded and while they move.
PACKED, PACKED_LEVEL = "zstd", 6
#: Ranges whose counts are added up together.
BLOCK = 1024


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: a count, ``length`` ids, a line feed."""
    return 2 + 2 * length + 1


def permute(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of ``numbers`` (all below ``n``): a keyed bijection of 0..n-1."""
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    low_mask, high_mask = np.uint64((1 << low) - 1), np.uint64((1 << (bits - low)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, key, np.uint64))
    x = numbers.astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        a, b = x[walk] >> np.uint64(low), x[walk] & low_mask
        for r in range(ROUNDS):
            if r % 2:
                b ^= mix(a + keys[r]) & low_mask
            else:
                a ^= mix(b + keys[r]) & high_mask
        x[walk] = (a << np.uint64(low)) | b
        walk = walk[x[walk] >= n]
    return x.astype(np.int64)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n, ids: each document's ids and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out, n = [], []
                for text in part.column("text"):
                    ids = encode(text.as_py())
                    if len(ids) and ids.max() >= 1 << 16:
                        raise ValueError("an id needs more than 16 bits")
                    out.append(np.append(ids, END_ID).astype("<u2").tobytes())
                    n.append(len(ids) + 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "h", "n", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id bigint, h binary, n bigint, ids binary")


def ranked(stored: DataFrame) -> DataFrame:
    """part, row, start, n: documents in order of id and text hash, each with its range and the ids before it there; a
    saved table. Only these narrow rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), batch.column("row"), pa.array(ends - n), batch.column("n")], ["part", "row", "start", "n"])
            start = int(ends[-1]) if len(n) else start

    # Rows alike may be dealt to several ranges: which of them comes first makes no difference.
    order = [F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row")]
    rows = stored.select("doc_id", "h", "row", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.select("row", "n").mapInArrow(run, "part bigint, row bigint, start bigint, n bigint"), sized=False)


def bases(rows: DataFrame) -> DataFrame:
    """part, base (ids before the range), n: a saved table."""
    counts = saved(rows.groupBy("part").agg(F.sum("n").alias("n")))
    # One row for each range, added up in blocks; one row for each block is what a single task sees.
    earlier = (Window.unboundedPreceding, -1)
    blocks = counts.groupBy(F.floor(F.col("part") / BLOCK).alias("block")).agg(F.sum("n").alias("all"))
    blocks = blocks.select("block", F.coalesce(F.sum("all").over(Window.orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(*earlier)), F.lit(0))
    return saved(counts.withColumn("block", F.floor(F.col("part") / BLOCK)).join(blocks, "block").select("part", (F.col("base") + within).alias("base"), "n"))


def stretches(placed: DataFrame, length: int) -> DataFrame:
    """seq, at, size (bytes), ids (packed): ``placed`` (place of the first id in the whole stream, n, ids) between multiples
    of ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = pa.Codec(PACKED, PACKED_LEVEL)
        for batch in batches:
            for part in slices(batch, "ids", 8 << 20):
                order = np.argsort(part.column("place").to_numpy())
                place, n = part.column("place").to_numpy()[order], part.column("n").to_numpy()[order]
                data = b"".join(part.column("ids").take(pa.array(order)).to_pylist())
                # Documents that follow each other are one run; runs begin where a place is not the end of the one before.
                opens = np.flatnonzero(np.concatenate([[True], place[1:] != (place + n)[:-1]]))
                offset = np.concatenate([[0], np.cumsum(n)])
                seq, at, size, ids = [], [], [], []
                for lo, first, last in zip(place[opens].tolist(), offset[opens].tolist(), offset[[*opens[1:], len(n)]].tolist(), strict=True):
                    hi = lo + last - first
                    for k in range(lo // length, -(-hi // length)):
                        a, b = max(lo, k * length), min(hi, (k + 1) * length)
                        seq.append(k)
                        at.append(a - k * length)
                        size.append(2 * (b - a))
                        ids.append(packer.compress(data[2 * (first + a - lo) : 2 * (first + b - lo)], asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())], ["seq", "at", "size", "ids"])

    return placed.select("place", "n", "ids").mapInArrow(run, "seq bigint, at int, size int, ids binary")


def assembled(pieces: DataFrame, length: int) -> DataFrame:
    """slot, n_tokens, tokens (padded) from stretches (slot, at, size, ids) that come by slot and place."""
    pad = np.full(length, END_ID, "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, out = None, [], []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([len(t) // 2 for _, t in out], pa.int32()), pa.array([t + pad[len(t) :] for _, t in out], pa.binary())], ["slot", "n_tokens", "tokens"])
        for batch in batches:
            for s, size, ids in zip(*(batch.column(c).to_pylist() for c in ("slot", "size", "ids")), strict=True):
                if s != slot and held:
                    out.append((slot, b"".join(held)))
                    held = []
                slot = s
                held.append(pa.decompress(ids, decompressed_size=size, codec=PACKED, asbytes=True))
            if len(out) >= 256:
                yield rows()
                out = []
        if held:
            out.append((slot, b"".join(held)))
        if out:
            yield rows()

    return pieces.select("slot", "size", "ids").mapInArrow(run, "slot bigint, n_tokens int, tokens binary")


def in_order(docs: DataFrame, key: int, length: int, shard: int) -> tuple[DataFrame, int]:
    """``training_order``, and the number of its records."""
    spark = docs.sparkSession
    with workspace(spark) as keep:
        stored = saved(encoded(docs).withColumn("row", F.monotonically_increasing_id()), sized=False, codec=PACKED, level=PACKED_LEVEL)
        rows = ranked(stored)
        base = bases(rows)
        places = saved(rows.join(small_side(base.select("part", "base")), "part").select("row", (F.col("base") + F.col("start")).alias("place")))
        keep += [stored, places]
        total = -(-base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // length)
    shards = max(1, -(-total // shard))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS)))

    @F.pandas_udf("bigint")
    def slot_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, key))

    placed = stored.join(small_side(places), "row").select("place", "n", "ids")
    pieces = stretches(placed, length).select(slot_of("seq").alias("slot"), "at", "size", "ids")
    dealt = pieces.repartitionById(tasks, F.floor(F.floor(F.col("slot") / shard) * tasks / shards).cast("int")).sortWithinPartitions("slot", "at")
    where = assembled(dealt, length).select("slot", F.floor(F.col("slot") / shard).alias("shard"), (F.col("slot") % shard).alias("record"), (F.col("slot") % shard * stride(length)).alias("byte_offset"), "n_tokens", "tokens")
    return where, total


def training_order(docs: DataFrame, key: int = KEY, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """slot, shard, record, byte_offset, n_tokens, tokens; every slot once, tasks hold ascending slot ranges."""
    return in_order(docs, key, length, shard)[0]


def write_shards(docs: DataFrame, path: str, key: int = KEY, length: int = LENGTH, shard: int = SHARD) -> None:
    """Below ``path``: ``manifest``, and in ``shards`` one directory per shard with one file of equal records; record r
    begins at byte r * ``stride(length)``, which is its ``byte_offset``."""
    ordered, total = in_order(docs, key, length, shard)
    n = F.lpad(F.hex(F.col("n_tokens")), 4, "0")
    count = F.unhex(F.concat(F.substring(n, 3, 2), F.substring(n, 1, 2)))
    sorted_rows = ordered.sortWithinPartitions("shard", "slot")  # as they come; says so to the writer
    sorted_rows.select("shard", F.concat(count, F.col("tokens")).cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/shards")
    facts = [(total, key, length, shard, stride(length))]
    docs.sparkSession.createDataFrame(facts, "records bigint, key bigint, length int, shard int, stride int").coalesce(1).write.json(f"{path}/manifest")


def read_from(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """slot, shard, record, byte_offset, n_tokens, tokens of the records of ``write_shards`` from ``slot`` on; each task
    goes to its place in a shard's file and reads forward."""
    facts = spark.read.schema("records bigint, key bigint, length int, shard int, stride int").json(f"{path}/manifest").first()
    records, length, shard, size = facts["records"], facts["length"], facts["shard"], facts["stride"]
    first, shards = max(0, slot), -(-records // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
        for number in (k for batch in batches for k in batch.column("id").to_pylist()):
            (name,) = (f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/shards/shard={number}")) if f.base_name.startswith("part-"))
            lo, hi = max(first, number * shard), min(records, (number + 1) * shard)
            with system.open_input_file(name) as f:
                for a in range(lo, hi, 256):
                    b = min(hi, a + 256)
                    data = np.frombuffer(f.read_at((b - a) * size, (a - number * shard) * size), np.uint8).reshape(b - a, size)
                    n = data[:, 0].astype(np.int32) + 256 * data[:, 1].astype(np.int32)
                    s = np.arange(a, b)
                    tokens = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.arange(b - a + 1) * 2 * length).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[:, 2:-1]))])
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(b - a, number)), pa.array(s % shard), pa.array(s % shard * size), pa.array(n), tokens], ["slot", "shard", "record", "byte_offset", "n_tokens", "tokens"])

    numbers = spark.range(first // shard, max(first // shard, shards), numPartitions=max(1, shards - first // shard))
    return numbers.mapInArrow(run, "slot bigint, shard bigint, record bigint, byte_offset bigint, n_tokens int, tokens binary")


def read_record(data: bytes) -> np.ndarray:
    """The ids that count of one record of ``write_shards``."""
    return np.frombuffer(data[2:-1], "<u2")[: int.from_bytes(data[:2], "little")]


def training_order_digest(docs: DataFrame) -> DataFrame:
    """The records of all shards, written and read from the first slot on, with a checksum of each."""

    @F.pandas_udf("bigint")
    def crc(tokens: pd.Series) -> pd.Series:
        return tokens.map(zlib.crc32).astype("int64")

    path = new_folder(docs.sparkSession, "shards")
    write_shards(docs, path)
    return read_from(docs.sparkSession, path).withColumn("crc32", crc("tokens"))
