"""Harmonic packing of token sequences (operator 10).

Pieces of documents are sorted into reciprocal-capacity classes: class k takes
lengths in (C/(k+1), C/k], and every bin of the class holds exactly k pieces.
A document is cut so that most of its tokens land on the exact reciprocals
C, C/2, C/4 ... C/32, whose bins fill without a gap; the tail of under C/32
tokens goes to its class among k > 32, whose bins are over 97 % full. Each
worker fills its own bins, nothing is shuffled. At the end of a worker's input
the pieces of unfinished bins are joined into full sequences; what is left is
cut at powers of two, which need no padding.

Defined cases: a null or empty text is one piece holding the end id; repeated
rows are packed once each; an empty table gives an empty result; columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import table, whole_text
from latentcf.llm.tokens import Encoder, default_vocabulary

CAPACITY = 2048
END_ID = 1
#: Lengths under this go to the classes of small pieces.
FINEST = CAPACITY // 32
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: sequence ids: the worker's number above, its own count below
WORKER_SHIFT = 40


def cuts(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Lengths of a document's pieces, in order: whole sequences, then halves of halves, then the tail."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= finest:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] if rest else out


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """One worker's bins. ``add`` and ``finish`` yield finished pieces as tuples of SCHEMA."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next_id = worker << WORKER_SHIFT
        self.open: dict[int, list] = defaultdict(list)  # class -> pieces (doc_id, start, ids, doc_tokens)

    def _close(self, pieces):
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids):
        start = 0
        for length in cuts(len(ids), self.capacity, max(1, self.capacity // 32)):
            k = self.capacity // length
            bin_ = self.open[k]
            bin_.append((doc_id, start, ids[start : start + length], len(ids)))
            start += length
            if len(bin_) == k:
                yield from self._close(bin_)
                self.open[k] = []

    def finish(self):
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        at, used = 0, 0  # next piece, ids of it already placed
        for size in sizes:
            pieces, room = [], size
            while room:
                doc_id, start, ids, n = left[at]
                part = ids[used : used + room]
                pieces.append((doc_id, start + used, part, n))
                room -= len(part)
                used += len(part)
                if used == len(ids):
                    at, used = at + 1, 0
            yield from self._close(pieces)


def _task(vocabulary: str):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode, packer = Encoder(vocabulary), Packer(TaskContext.get().partitionId())
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def batch(rows):
            columns = list(zip(*rows)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        out = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text)
                ids.append(END_ID)
                out.extend(packer.add(doc_id, np.array(ids, dtype="<u4")))
                if len(out) >= 20_000:
                    yield batch(out)
                    out = []
        out.extend(packer.finish())
        yield batch(out)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece (SCHEMA). Sequence ids are unique, not dense: the worker's number leads."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return picked.mapInArrow(_task(vocabulary or default_vocabulary()), SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
