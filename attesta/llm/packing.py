"""Packing of tokenized documents into windows by multiway differencing.

Each task tokenizes the rows of its own input partition, so nothing is shuffled and a hot source or a long document needs
no care. Full windows are cut from a document's front and leave at once; only the rests, each shorter than a window, are
held until GROUP of them are there. The rests of a group are dealt into k windows by Karmarkar-Karp differencing: the two
partial partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the other, until
one is left. What a window then holds beyond the capacity is cut off and dealt once more, with the windows as items. k
starts at the fewest windows that could hold the tokens and rises when such a cut leaves no less to deal than the one
before. So a rest is cut only where the balance needs it.

Ids are those of the `tokenizers` library with add_special_tokens=False: the characters of an added token in a text (such
as <|endoftext|>) give that token's id. Texts with such characters are encoded by the library itself, all others by a
faster encoder of the same vocabulary.

Defined cases: a null or empty text has the end id alone; repeated rows are each packed; ids of any doc_id (null too)
pass through; a text of any length is encoded whole; other columns of any name play no part; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

from attesta.llm import tokens

CAPACITY = 1024
#: Rests that are dealt together; rows that a worker hands over at a time.
GROUP, ROWS = 512, 4096
END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def deal(sizes: list[int], k: int) -> list[list[int]]:
    """The items (by position) of each of k windows, near-equal in total; largest differencing over k-tuples.

    A partial partition holds its window totals in falling order, less the smallest of them. Only its non-zero windows
    are listed, so merging costs their number; zeros are implied at the end.
    """
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:  # fullest of one with empty ones of the other
            sums, windows = a + b, wa + wb
        else:
            # the last `over` of a meet the last of b in opposite order
            free_a, free_b = len(a) - over, len(b) - over
            sums = a[:free_a] + b[:free_b] + [x + y for x, y in zip(a[free_a:], reversed(b[free_b:]), strict=True)]
            windows = wa[:free_a] + wb[:free_b] + [x + y for x, y in zip(wa[free_a:], reversed(wb[free_b:]), strict=True)]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, windows = [sums[i] for i in order], [windows[i] for i in order]
        if len(sums) == k and sums[-1]:
            least = sums[-1]
            sums = [s - least for s in sums]
        heapq.heappush(heap, (-sums[0], serial, sums, windows))
        serial += 1
    return heap[0][3] if heap else []


#: (item, first token of the item, tokens)
Piece = tuple[int, int, int]


def trimmed(window: list[Piece], capacity: int) -> tuple[list[Piece], list[Piece]]:
    """A window within the capacity, and what was taken from it: whole pieces from the largest on, then the end of one."""
    over, stay, gone = sum(p[2] for p in window) - capacity, sorted(window, key=lambda p: p[2]), []
    while over > 0:
        item, start, n = stay.pop()
        taken = min(n, over)
        gone.append((item, start + n - taken, taken))
        if taken < n:
            stay.append((item, start, n - taken))
        over -= taken
    return stay, gone


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Pieces that cover items of these sizes (each within the capacity) in windows within the capacity."""
    k, left = max(1, -(-sum(sizes) // capacity)), None
    units: list[list[Piece]] = [[(i, 0, n)] for i, n in enumerate(sizes)]
    while units:
        dealt = ([p for u in w for p in units[u]] for w in deal([sum(p[2] for p in u) for u in units], k))
        kept, loose = [], []
        for window in dealt:
            if window:
                stay, gone = trimmed(window, capacity)
                kept.append(stay)
                loose += gone
        if not loose:
            return kept
        now = sum(p[2] for p in loose)
        k, left, units = k + (left is not None and now >= left), now, kept + [[p] for p in loose]
    return []


class Packer:
    """Rows of SCHEMA for documents that come one by one; holds at most `group` rests."""

    def __init__(self, first: int, capacity: int, group: int):
        self.at, self.capacity, self.group, self.rests = first, capacity, group, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """The document's full windows, and those of a group of rests that it completes."""
        n, size = len(ids), self.capacity
        full = n - n % size
        for start in range(0, full, size):
            yield doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, self.at, 0
            self.at += 1
        if full < n:
            self.rests.append((doc_id, full, ids[full:].copy(), n))
            if len(self.rests) >= self.group:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for window in windows([len(r[2]) for r in self.rests], self.capacity):
            offset = 0
            for item, start, n in sorted(window):
                doc_id, before, ids, total = self.rests[item]
                yield doc_id, before + start, n, zlib.crc32(ids[start : start + n].tobytes()), total, self.at, offset
                offset += n
            self.at += 1
        self.rests.clear()


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces of all documents (doc_id, text) with their windows; sequence ids are unique, not dense."""
    spark = docs.sparkSession
    source = path or tokens.default_path("byte_bpe_50k.json")
    ranks: Broadcast = tokens.shared(spark, tokens.ranks_of_json(source))
    # a file of fixed size, as the vocabulary
    spec: Broadcast = spark.sparkContext.broadcast(tokens.spec_of_json(source))
    names = [f.partition(" ")[0] for f in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.library_ids(ranks, spec)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, group)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for i, doc_id in enumerate(ids):
                    yield from packer.add(doc_id, np.array([*encode(texts[i].as_py() or ""), END], dtype="<u4"))
            yield from packer.flush()

        todo = rows()
        while part := list(islice(todo, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
