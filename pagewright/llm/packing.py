"""Order-preserving packing: windows of at most ``WINDOW`` ids, cut by dynamic programming.

Each task packs its partition's documents in their order, block by block. Candidate cuts are document ends (free),
sentence ends and, inside long stretches without either, regular places. With f(j) the least cost of the stream up
to candidate j, f(j) = penalty(j) + WINDOW - pos(j) + min over i within WINDOW of f(i) + pos(i): a sliding minimum,
kept in a monotone queue, so a block costs one pass over its candidates. A partition's last, short window is split
into powers of two, which are not padded, where that is cheaper.

No shuffle; memory is a block of ids plus one document. A task's result depends on its partition's rows only, so a
lost task is redone alike; input whose rows may change places on recomputation should be written first.

Null text counts as empty: its document is the single end id. Repeated rows and null ids are packed as they come.
An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import encode, sentence_ends

WINDOW, END_ID = 2048, 1
#: Costs in ids of padding: a cut at a sentence end, and one inside a sentence.
SENTENCE_CUT, INNER_CUT = 2.0, 12.0
#: Sentence ends closer than this to the last candidate are passed over; longer stretches get inner candidates.
LEAST_GAP, MOST_GAP, INNER_STEP = 16, 40, 20
BLOCK_IDS = 1 << 20

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def candidates(ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut places after 0 and their penalties; the last is the stream's end."""
    sentence = np.flatnonzero(sentence_ends()[ids]) + 1
    cell = sentence // LEAST_GAP
    sentence = sentence[np.flatnonzero(np.diff(cell, append=-1))]  # the last of each cell
    place = np.unique(np.concatenate([sentence, doc_ends]))
    gaps = np.diff(place, prepend=0)
    inner = [np.arange(p - g + INNER_STEP, p, INNER_STEP) for p, g in zip(place[gaps > MOST_GAP], gaps[gaps > MOST_GAP], strict=True)]
    if inner:
        inner = np.concatenate(inner)
        all_places = np.union1d(place, inner)
    else:
        all_places = place
    cost = np.full(len(all_places), INNER_CUT)
    cost[np.searchsorted(all_places, place)] = SENTENCE_CUT
    cost[np.searchsorted(all_places, doc_ends)] = 0.0
    return all_places, cost


def best_cuts(place: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest chain of candidate places from 0 to the last one, no step over ``window``."""
    pos, pen = [0, *place.tolist()], [0.0, *cost.tolist()]
    came = [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(i) + pos(i) ascending; pos, index
    push, pop, shift = queue.append, queue.pop, queue.popleft
    for j in range(1, len(pos)):
        p = pos[j]
        while p - queue[0][1] > window:
            shift()
        head = queue[0]
        came[j] = head[2]
        value = pen[j] + window + head[0]  # f(j) + pos(j)
        while queue and queue[-1][0] >= value:
            pop()
        push((value, p, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = came[j]
    return out[::-1]


def tail_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Lengths for a last window of ``n`` ids: whole if padding is cheap, else powers of two."""
    bits = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return [n] if len(bits) == 1 or window - n <= INNER_CUT * (len(bits) - 1) else bits


class Stream:
    """Documents whose ids are not all packed yet."""

    def __init__(self, first_sequence: int):
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc_id, ids before, length here, ids in all
        self.size, self.sequence = 0, first_sequence

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        """Pieces of all finished windows; the open one stays unless ``last``."""
        if not self.size:
            return None
        ids = np.concatenate(self.parts)
        ends = np.cumsum([d[2] for d in self.docs])
        cuts = best_cuts(*candidates(ids, ends))
        begun = cuts[-2] if len(cuts) > 1 else 0
        if last:
            cuts = [*cuts[:-1], *(begun + np.cumsum(tail_lengths(len(ids) - begun))).tolist()]
        elif begun:
            cuts = cuts[:-1]
        else:
            return None
        done = cuts[-1]
        starts = ends - [d[2] for d in self.docs]
        edges = np.union1d(np.concatenate([[0], cuts]), ends[ends <= done])
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, a, "right")
        seq = np.searchsorted(cuts, a, "right")
        before = np.array([d[1] for d in self.docs])
        window_start = np.concatenate([[0], cuts])[seq]
        raw = ids.tobytes()
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc], pa.int64()),
                pa.array(before[doc] + a - starts[doc]),
                pa.array(b - a),
                pa.array(crc, pa.int64()),
                pa.array(np.array([d[3] for d in self.docs])[doc]),
                pa.array(self.sequence + seq),
                pa.array(a - window_start),
            ],
            NAMES,
        )
        self.sequence += len(cuts)
        rest = np.flatnonzero(ends > done)
        self.docs = [(d[0], d[1] + max(0, done - int(starts[i])), int(ends[i]) - max(done, int(starts[i])), d[3]) for i in rest if (d := self.docs[i])]
        self.parts, self.size = [ids[done:]], len(ids) - done
        return out


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequence ids hold the task's partition in their upper bits; they ascend with the documents of a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids_of, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                stream.add(ids_of[i].as_py(), np.append(encode(texts[i].as_py() or ""), np.uint32(END_ID)))
                if stream.size >= BLOCK_IDS and (out := stream.pack(False)) is not None:
                    yield out
        if (out := stream.pack(True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
