"""Best-fit packing of documents into fixed-size training rows: bounded-space online best fit.

Documents are packed in the order in which their partition is read, with a fixed number of open bins. Open bins are keyed by their free space in a bitset
(one big integer), so that the fullest bin that still has room is found with a shift and a lowest set bit. If no open bin has room and all are in use, the fullest closes first.
Each partition has its own open bins: nothing is shuffled, and the state of a task is bounded by ``OPEN`` bins whatever the input.

A document longer than a bin fills bins of its own, and its last piece is packed like a short document; no word is dropped. A bin's id is the partition's
number and the bin's place in it, so ids follow how the table is split into partitions; the packing itself is deterministic for given partitions.

Defined results: ids are integers, or strings of them (others fail in the cast); null, empty and wordless texts take no room and are in no bin; rows that are repeated are packed again, each on its own; a null doc_id is packed as null;
ties between bins of equal free space go to the bin that reached that free space first; an empty table gives no bins. Other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

#: Words a bin holds, and bins open at once in a task.
CAPACITY, OPEN = 2048, 64
_PIECE = pa.struct([("doc_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])
SCHEMA = "bin long, used int, free int, doc_ids array<long>, pieces array<struct<doc_id: long, first_word: long, words: long, start_byte: long, end_byte: long>>"


class Packer:
    """Bounded-space best fit. Pieces are tuples whose third field is their size."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN):
        if capacity < 1 or most < 1:
            raise ValueError("capacity and open bins must be positive")
        self.capacity, self.most = capacity, most
        self.bits, self.count = 0, 0
        self.at: dict[int, deque] = {}

    def _take(self, free: int) -> list:
        group = self.at[free]
        got = group.popleft()
        if not group:
            self.bits &= ~(1 << free)
        self.count -= 1
        return got

    def _put(self, free: int, pieces: list) -> None:
        self.at.setdefault(free, deque()).append(pieces)
        self.bits |= 1 << free
        self.count += 1

    def add(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """Pack one piece of 1 to ``capacity`` words; gives the bins (free, pieces) that this closes."""
        n = piece[2]
        room = self.bits >> n
        if room:
            free = n + (room & -room).bit_length() - 1
            pieces = self._take(free)
        else:
            if self.count == self.most and n < self.capacity:
                least = (self.bits & -self.bits).bit_length() - 1
                yield least, self._take(least)
            free, pieces = self.capacity, []
        pieces.append(piece)
        if free == n:
            yield 0, pieces
        else:
            self._put(free - n, pieces)

    def close(self) -> Iterator[tuple[int, list]]:
        """All open bins, the fullest first."""
        while self.bits:
            least = (self.bits & -self.bits).bit_length() - 1
            yield least, self._take(least)


def pack(docs: DataFrame, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """One row a bin: its used and free words, the documents in it, and their pieces in words and UTF-8 bytes."""

    def run(batches):
        packer = Packer(capacity, most)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40

        def batch(bins):
            nonlocal number
            ids = np.arange(number, number + len(bins))
            number += len(bins)
            flat = [dict(zip(("doc_id", "first_word", "words", "start_byte", "end_byte"), p)) for _, ps in bins for p in ps]
            off = pa.array(np.concatenate(([0], np.cumsum([len(ps) for _, ps in bins]))), pa.int32())
            free = np.array([f for f, _ in bins], np.int32)
            docs_of = pa.ListArray.from_arrays(off, pa.array([p["doc_id"] for p in flat], pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(capacity - free), pa.array(free), docs_of, pa.ListArray.from_arrays(off, pa.array(flat, _PIECE))], names=["bin", "used", "free", "doc_ids", "pieces"]
            )

        ready: list[tuple[int, list]] = []
        for b in batches:
            ids, gone = K.id_array(b.column(0))
            for c in K.chunks(b.column(1)):
                st, en, ptr = c.words()
                for k, r in enumerate(c.rows):
                    i, j = int(ptr[k]), int(ptr[k + 1])
                    doc = None if gone[r] else int(ids[r])
                    # pieces meet where the next one's first word starts, so that they join to the whole text
                    for lo in range(i, j, capacity):
                        hi = min(lo + capacity, j)
                        start = 0 if lo == i else int(st[lo] - c.off[k])
                        end = int((c.off[k + 1] if hi == j else st[hi]) - c.off[k])
                        ready += packer.add((doc, lo - i, hi - lo, start, end))
            if len(ready) > 2000:
                yield batch(ready)
                ready = []
        ready += packer.close()
        if ready:
            yield batch(ready)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
