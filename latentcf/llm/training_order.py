"""Training-order materialisation of token sequences (operator 4).

Documents are tokenised, each closed by the end-of-text id, and strung into
sequences of LENGTH ids per worker; a worker's last sequence is filled up with
end-of-text ids. With the sequences counted, each has a global index, and a
keyed Feistel network over the next even power of two, walked along its cycle
until it lands below the count, gives it a slot: a permutation of all
sequences that any worker computes by itself. Ranges of slots go to one task
each, which writes them as a shard: ids as little-endian 16-bit numbers, one
fixed stride per sequence, so slot s lies at (s mod shard size) * stride of
shard s div shard size. Reading from any slot on is one seek.

Sequences travel compressed. Shards appear only when whole, under a name that
follows from their slots, so a task that is lost or run twice changes nothing.

Defined cases: a null or empty text is one end-of-text id; repeated rows are
written once each; an empty table writes no shard; columns besides doc_id and
text are not read. The order of sequences before the permutation is that of
the input's partitions.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import release, settle, table, whole_text
from latentcf.llm.files import Publisher, filesystem
from latentcf.llm.tokens import END_OF_TEXT_ID, Encoder, default_vocabulary
from latentcf.session import scratch_path

LENGTH = 2048
KEY = "training-order"
FEISTEL_ROUNDS = 6
#: sequences of a shard (of 4 KB each: 32 MB)
PER_SHARD = 8192


class SlotPermutation:
    """A keyed permutation of 0 .. n-1, on arrays of indexes."""

    def __init__(self, n: int, key: str = KEY, rounds: int = FEISTEL_ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.frombuffer(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "<u8")[0]
                     for r in range(rounds)]

    def _round(self, x, key):
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x, step):
        out = step(np.asarray(x, np.uint64))
        beyond = out >= self.n
        while beyond.any():  # off the end: go on along the cycle
            out[beyond] = step(out[beyond])
            beyond = out >= self.n
        return out

    def _there(self, x):
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._round(right, k)
        return (left << self.half) | right

    def _back(self, x):
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ self._round(left, k), left
        return (left << self.half) | right

    def slot(self, index):
        return self._walk(index, self._there)

    def index(self, slot):
        return self._walk(slot, self._back)


def _sequence_task(vocabulary: str, length: int):
    def run(batches):
        import pyarrow as pa

        encode, worker = Encoder(vocabulary), TaskContext.get().partitionId()
        held, first, made = [], None, 0  # ids short of a sequence, the document of the first of them

        def out(blocks, firsts):
            nonlocal made
            place = list(range(made, made + len(blocks)))
            made += len(blocks)
            return pa.RecordBatch.from_arrays([pa.array([worker] * len(blocks), pa.int32()), pa.array(place, pa.int64()),
                                               pa.array(firsts, pa.int64()), pa.array(blocks, pa.binary())],
                                              names=["worker", "place", "first_doc_id", "ids"])

        for b in batches:
            blocks, firsts = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not held:
                    first = doc_id
                held += encode(text)
                held.append(END_OF_TEXT_ID)
                if len(held) >= length:
                    whole = len(held) // length * length
                    ids = np.array(held[:whole], "<u2").reshape(-1, length)
                    blocks += [row.tobytes() for row in ids]
                    firsts += [first] + [doc_id] * (len(ids) - 1)
                    held, first = held[whole:], doc_id
            if blocks:
                yield out(blocks, firsts)
        if held:
            yield out([np.array(held + [END_OF_TEXT_ID] * (length - len(held)), "<u2").tobytes()], [first])

    return run


def sequences(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """(worker, place, first_doc_id, ids) of fixed-length sequences, written once: the ids are
    needed after they have been counted, and tokenising is the dear part."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    made = picked.mapInArrow(_sequence_task(vocabulary or default_vocabulary(), length),
                             "worker int, place long, first_doc_id long, ids binary")
    path = scratch_path(docs.sparkSession, "sequences")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _place_task(total: int, offsets: dict[int, int], key: str, per_shard: int):
    def run(batches):
        import pyarrow as pa
        import zstandard

        order, pack = SlotPermutation(total, key), zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = np.array([offsets[w] for w in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            slots = order.slot(at).astype(np.int64)
            ids = pa.array([pack.compress(x) for x in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slots // per_shard), pa.array(slots), pa.array(at), b.column(2), ids],
                                             names=["shard", "slot", "sequence_id", "first_doc_id", "ids"])

    return run


def _shard_task(folder: str, per_shard: int):
    """Rows by (shard, slot) -> shards of fixed stride, and where each sequence lies."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack, out, now = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            offsets, checks = [], []
            for shard, ids in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                if shard != now:
                    if out:
                        out.publish()
                    out, now = Publisher(folder, shard_name(shard)), shard
                data = unpack.decompress(ids)
                offsets.append(out.write(data)[0])
                checks.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(offsets, pa.int64()), b.column(2), b.column(3),
                                              pa.array(checks, pa.int64())],
                                             names=["slot", "shard", "byte_offset", "sequence_id", "first_doc_id", "crc32"])
        if out:
            out.publish()

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.u16"


def materialise(docs: DataFrame, folder: str, vocabulary: str | None = None, length: int = LENGTH, key: str = KEY,
                per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards of ``docs`` below ``folder``; returns one row per sequence: slot, shard,
    byte_offset, sequence_id, first_doc_id, crc32 of its bytes."""
    made = sequences(docs, vocabulary, length)
    counts = made.groupBy("worker").count().orderBy("worker").collect()  # a row per worker
    offsets, total = {}, 0
    for r in counts:
        offsets[r["worker"]] = total
        total += r["count"]
    placed = made.mapInArrow(_place_task(total, offsets, key, per_shard),
                             "shard long, slot long, sequence_id long, first_doc_id long, ids binary")
    shards = max(1, -(-total // per_shard))
    # ranges of slots, one to a task: partition i is shard i
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    index = settle(dealt.mapInArrow(_shard_task(folder, per_shard), "slot long, shard long, byte_offset long, "
                                    "sequence_id long, first_doc_id long, crc32 long"), "training-index")
    release(made)
    return index


def read_slots(folder: str, start: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD):
    """Ids of ``n`` sequences from slot ``start`` on, in training order (fewer at the end)."""
    fs, base = filesystem(folder)
    stride, slot = 2 * length, start
    while slot < start + n:
        shard, place = divmod(slot, per_shard)
        path = f"{base.rstrip('/')}/{shard_name(shard)}"
        if not fs.get_file_info(path).is_file:
            return
        with fs.open_input_file(path) as f:
            f.seek(place * stride)
            while slot < start + n and slot // per_shard == shard:
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield slot, np.frombuffer(data, "<u2")
                slot += 1


def op4_training_order(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "training-shards")
    return materialise(table(spark, sf_dir, "documents"), folder)
