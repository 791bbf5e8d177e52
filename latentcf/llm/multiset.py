"""Homomorphic multiset fingerprints of documents (operator 2).

A text's fingerprint is the sum of wide vectors, one per paragraph (line), with
every lane taken modulo a power of two. The sum does not depend on the order
of paragraphs, and a paragraph is inserted or deleted by adding or subtracting
its vector; no other part of the text is read again.

A paragraph's vector has two parts. Its first lanes (modulo 2^64) are an
extendable hash of the paragraph: equal multisets of paragraphs, and for all
practical purposes only these, have equal sums. Its other lanes (modulo 2^32)
hold a signed count of the paragraph's hashed word pairs, which is a sum over
paragraphs as well; the cosine of two such parts estimates how much of the
texts is shared, so a likeness can be read off two fingerprints alone.

Texts that differ only in the order of their paragraphs have equal fingerprints.

Defined cases: null is read as empty; an empty text has the fingerprint of one
empty paragraph, and two texts without words have likeness 1 if equal, else 0;
the next document follows by (doc_id, a hash of its text), rows without doc_id
first; repeated rows follow each other, and a doc_id that very many rows share is spread over tasks; a table of one row is its own next; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import settle, table, whole_text

HASH_LANES = 8
PAIR_LANES = 128

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each ASCII-white-space separated word, and whether it begins a paragraph;
    array operations over the whole text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], (raw > 32) | ((raw < 9) | ((raw > 13) & (raw < 32))), [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, bool)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _MULTIPLIER, np.uint64))
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        sums = np.add.reduceat((raw[inside[1:-1]].astype(np.uint64) + np.uint64(1)) * powers[within], first)
    line = np.searchsorted(np.flatnonzero(raw == 10), starts)
    return _mix(sums), np.concatenate(([True], line[1:] != line[:-1]))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of the summed vectors of a text's paragraphs."""
    data = text.encode()
    digests = b"".join([hashlib.shake_128(p).digest(8 * HASH_LANES) for p in data.split(b"\n")])
    hashed = np.frombuffer(digests, "<u8").reshape(-1, HASH_LANES).sum(axis=0, dtype=np.uint64)
    words, begins = _word_hashes(data)
    if not len(words):
        return hashed, np.zeros(PAIR_LANES, np.uint32)
    with np.errstate(over="ignore"):
        before = np.concatenate(([np.uint64(1)], words[:-1]))
        before[begins] = 1  # pairs do not reach over paragraphs
        pairs = _mix(before * _MULTIPLIER + words)
    signs = np.where(pairs & np.uint64(1), 1.0, -1.0)
    lanes = np.bincount(((pairs >> np.uint64(1)) % np.uint64(PAIR_LANES)).astype(np.int64), signs, PAIR_LANES)
    return hashed, lanes.astype(np.int64).astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors; ``add`` and ``remove`` change it by the paragraphs of a text."""

    def __init__(self, text: str | None = None):
        self.hashed, self.pairs = np.zeros(HASH_LANES, np.uint64), np.zeros(PAIR_LANES, np.uint32)
        if text is not None:
            self.add(text)

    def add(self, paragraphs: str) -> Fingerprint:
        hashed, pairs = vector(paragraphs)
        self.hashed, self.pairs = self.hashed + hashed, self.pairs + pairs
        return self

    def remove(self, paragraphs: str) -> Fingerprint:
        hashed, pairs = vector(paragraphs)
        self.hashed, self.pairs = self.hashed - hashed, self.pairs - pairs
        return self

    def hex(self) -> str:
        return self.hashed.astype("<u8").tobytes().hex() + self.pairs.astype("<u4").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        out, data = cls(), bytes.fromhex(text)
        out.hashed = np.frombuffer(data[: 8 * HASH_LANES], "<u8")
        out.pairs = np.frombuffer(data[8 * HASH_LANES :], "<u4")
        return out

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else the cosine of the pair counts, within 0 to 1."""
        if np.array_equal(self.hashed, other.hashed) and np.array_equal(self.pairs, other.pairs):
            return 1.0
        a, b = (x.pairs.view(np.int32).astype(float) for x in (self, other))
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(1.0, max(0.0, a @ b / size))) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pair_task(batches):
    """Rows sorted by (bucket, place): every row is followed by its next in the same bucket; the
    last row of a bucket is a copy of the next bucket's first and only ends it."""
    import pyarrow as pa

    def finished(now, text, sign, following, next_sign):
        new = edited(text, following)
        # only the paragraphs behind the cut are exchanged
        kept = len(text) - len(text) // 2
        line = text.rfind("\n", 0, kept) + 1
        changed = Fingerprint()
        changed.hashed, changed.pairs = sign.hashed, sign.pairs
        changed.remove(text[line:]).add(new[line:])
        return (now, len(text), hashlib.sha256(new.encode()).hexdigest(), sign.hex(), changed.hex(),
                sign.likeness(changed), sign.likeness(next_sign))

    held, out = None, []
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names=names)

    for b in batches:
        for bucket, doc_id, text in zip(*[b.column(i).to_pylist() for i in range(3)]):
            sign = Fingerprint(text)
            if held and held[0] == bucket:
                out.append(finished(*held[1:], text, sign))
            held = (bucket, doc_id, text, sign)
        if len(out) >= 500:
            yield batch(out)
            out = []
    yield batch(out)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def chain(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, doc_id, text) sorted so that each row's next document follows it in its bucket.

    Whole texts are shuffled once. Buckets are ranges of (doc_id, hash of the text); where the
    next bucket begins is known from a pass over the ids alone, so its first row is sent to both.
    The driver sees one row per bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # order: rows without doc_id first, then by doc_id, repeats by the hash of their text
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = settle(rows.select(order.alias("o")).select("o.id", "o.tie"), "chain-ids")
    # several ranges to a task: they even out; but none for a handful of rows
    buckets = buckets or max(1, min(4 * parts, ids.count() // 64))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = ids.select(F.percentile_approx("id", shares, 100 * buckets)).first()[0] if shares else []
    bucket_of, span = _ranges(cuts or [])
    firsts = (ids.select(bucket_of(F.col("id"), F.col("tie")).alias("bucket"), F.struct("id", "tie").alias("o"))
              .groupBy("bucket").agg(F.min("o").alias("o")).orderBy("bucket").collect())
    if not firsts:
        return rows.select(F.lit(0).cast("long").alias("bucket"), "doc_id", "text")
    # the first row of each bucket also ends the bucket before it; the first of all ends the last
    before = {firsts[i]["bucket"]: firsts[i - 1]["bucket"] for i in range(len(firsts))}
    table_ = spark.createDataFrame([(f["bucket"], f["o"]["id"], f["o"]["tie"], before[f["bucket"]]) for f in firsts],
                                   "b long, first_id long, first_tie long, previous long")
    placed = rows.withColumn("o", order).withColumn("bucket", bucket_of(F.col("o.id"), F.col("o.tie")))
    # one row per bucket
    ending = (placed.join(F.broadcast(table_), (placed.bucket == F.col("b")) & (F.col("o.id") == F.col("first_id"))
                          & (F.col("o.tie") == F.col("first_tie"))))
    ending = ending.dropDuplicates(["b"]).select(F.col("previous").alias("bucket"), F.lit(1).alias("end"), "o", "doc_id", "text")
    dealt = placed.select("bucket", F.lit(0).alias("end"), "o", "doc_id", "text").union(ending)
    parts = min(parts, len(firsts))
    # neighbouring ranges share a task, as many to each
    return (dealt.repartitionById(parts, F.floor(F.col("bucket") * parts / span).cast("int"))
            .sortWithinPartitions("bucket", "end", "o").select("bucket", "doc_id", "text"))


def _ranges(cuts: list[int]):
    """A function (id, tie) -> number of its range, in order, and the numbers' bound. An id that several cuts fall on has that many
    ranges of its own, by its rows' hashes."""
    edges, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    own = np.append(np.where(times > 1, times, 0), 0)
    step = int(own.max(initial=0)) + 1

    @F.pandas_udf("long")
    def bucket_of(id_: pd.Series, tie: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, id_.to_numpy(), "left")
        n = np.where(np.append(edges, 0)[at] == id_.to_numpy(), own[at], 0)
        part = np.where(n > 0, 1 + np.floor((tie.to_numpy() / 2.0**64 + 0.5) * n), 0)
        return pd.Series((at * step + np.minimum(part, n)).astype(np.int64))

    return bucket_of, (len(edges) + 1) * step


def op2_multiset(spark, sf_dir: str) -> DataFrame:
    return chain(table(spark, sf_dir, "documents")).mapInArrow(_pair_task, SCHEMA)
