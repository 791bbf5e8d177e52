"""SimHash near-duplicates over a Gray-order hierarchical index (operator 3).

Fingerprints: 64 bits, each set where over half of the XXH64 hashes of a
text's word shingles (repeats included) have it.

Index: the top level factors shared masked bit patterns. The 64 bits fall
into six blocks; of two fingerprints at most MAX_BITS = 4 bits apart at least
two blocks agree, so each pair meets under one of the 15 masks of two blocks,
with no difference accumulated yet. Under each (mask, pattern) the members are
sorted by Gray rank, so neighbours share long patterns, and are factored into
nodes of 16, these into nodes of 16 and so on; a node keeps the mask of bits on
which all its members agree and their pattern. A search walks the levels down
and drops every group whose differences on the shared bits exceed the limit.

Equal fingerprints are one member. A pattern with more than CELL members is
dealt into chunks, and pairs of chunks are separate tasks, so no task holds
more than two chunks. Tasks emit spanning edges, never all pairs; components
come from alternating stars over these edges.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows share their component; a null doc_id takes part but is
never a component's id unless the whole component has none; empty tables give
empty results; other columns are not read (``keep_one`` passes them through).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import keyed_rows, release, settle, table, whole_text
from latentcf.llm.components import connected_components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: members of one pattern in a chunk
CELL = 4096
#: groups up to this size are compared directly, larger ones through the index
DIRECT = 48
FANOUT = 16
BLOCKS = (11, 11, 11, 11, 10, 10)


def masks() -> list[int]:
    """Masks of two of the six blocks, as signed 64-bit numbers."""
    blocks, low = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << low)
        low += width
    both = (a | b for a, b in combinations(blocks, 2))
    return [m - (1 << 64) if m >> 63 else m for m in both]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The text's fingerprint (unsigned); ASCII case folding and ASCII white space only."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    hash_ = xxhash.xxh64_intdigest
    hashes = np.array([hash_(joined[s:e], SEED) for s, e in
                       zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], ">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # long texts in steps
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprint_task(shingle: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))],
                                             names=[*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, *keys: str, shingle: int = SHINGLE) -> DataFrame:
    """The key columns and ``fp`` (the fingerprint as a signed long) of every row."""
    picked = docs.select(*[F.col(f"`{k}`").cast("long").alias(k) for k in keys], whole_text().alias("_text"))
    schema = ", ".join([f"`{k}` long" for k in keys] + ["fp long"])
    return picked.mapInArrow(_fingerprint_task(shingle), schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each bit pattern in Gray order."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Members in Gray order under levels of masked patterns; members can be taken out."""

    def __init__(self, members: np.ndarray):
        self.members = members[np.argsort(gray_rank(members), kind="stable")]
        self.alive = np.ones(len(members), bool)
        self.levels = []  # from the lowest: (pattern, mask of the bits shared)
        ones, either = self.members, self.members
        while len(ones) > FANOUT:
            cut = np.arange(0, len(ones), FANOUT)
            ones, either = np.bitwise_and.reduceat(ones, cut), np.bitwise_or.reduceat(either, cut)
            self.levels.append((ones, ~(ones ^ either)))

    def near(self, q: np.uint64, limit: int) -> np.ndarray:
        """Places of the living members within ``limit`` bits of ``q``."""
        sizes = [len(self.members)] + [len(pattern) for pattern, _ in self.levels]
        at = np.arange(sizes[-1])
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[level]
            at = at[np.bitwise_count((q ^ pattern[at]) & mask[at]) <= limit]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < sizes[level]]  # the last node of a level may be short
        at = at[self.alive[at]]
        return at[np.bitwise_count(q ^ self.members[at]) <= limit]

    def spanning(self, limit: int):
        """Edges of a spanning forest: each member is reached once and searched from once."""
        for root in range(len(self.members)):
            if not self.alive[root]:
                continue
            self.alive[root] = False
            front = [root]
            while front:
                here = front.pop()
                found = self.near(self.members[here], limit)
                self.alive[found] = False
                front.extend(found.tolist())
                for other in found:
                    yield self.members[other], self.members[here]


def _direct_edges(group: np.ndarray, fp: np.ndarray, limit: int):
    """Spanning edges inside runs of equal ``group`` numbers (all short), by shifted comparison."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for shift in range(1, DIRECT):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        hit = np.flatnonzero(same & (np.bitwise_count(fp[shift:] ^ fp[:-shift]) <= limit))
        for i in hit.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield fp[i], fp[i + shift]


def _link_task(limit: int):
    """Rows sorted by (mask, pattern, cell) -> spanning edges within each."""

    def edges(group, fp):
        cut = np.flatnonzero(np.diff(group)) + 1
        bounds = np.concatenate(([0], cut, [len(group)]))
        size = np.diff(bounds)
        short = np.repeat((size > 1) & (size <= DIRECT), size)
        yield from _direct_edges(group[short], fp[short], limit)
        for k in np.flatnonzero(size > DIRECT):
            yield from GrayIndex(np.unique(fp[bounds[k] : bounds[k + 1]])).spanning(limit)

    def run(batches):
        import pyarrow as pa

        def out(group, fp):
            pairs = np.array(list(edges(group, fp)), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held, number, last = [], 0, None  # rows of the group that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            fp = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            new[0] = first != last
            last = tuple(k[-1] for k in keys)
            group = number + np.cumsum(new)
            number = int(group[-1])
            held.append((group, fp))
            group, fp = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            done = group < number
            if done.any():
                yield out(group[done], fp[done])
            held = [(group[~done], fp[~done])]
        if held:
            yield out(*held[0])

    return run


def link(members: DataFrame, limit: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints at most ``limit`` bits apart.

    ``members`` has one row per distinct ``fp``. Exact for every limit up to 4:
    no pair is lost to the index, the chunks or a hot pattern.
    """
    if limit > MAX_BITS:
        raise ValueError("six blocks, two of them equal, cover up to 4 differing bits")
    under = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern"))
                                for i, m in enumerate(masks())]))
    rows = members.select("fp", under.alias("u")).select("u.mask", "u.pattern", "fp")
    hot = settle(rows.groupBy("mask", "pattern").count().where(F.col("count") > cell)
                 .select("mask", "pattern", F.ceil(F.col("count") / cell).cast("int").alias("chunks")), "simhash-hot")
    dealt = rows.join(hot, ["mask", "pattern"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = (dealt.select("mask", "pattern", "fp", "chunks", chunk.alias("own"), other.alias("other"))
             .select("mask", "pattern",
                     (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")).cast("long").alias("cell"), "fp"))
    sorted_ = cells.repartition("mask", "pattern", "cell").sortWithinPartitions("mask", "pattern", "cell", "fp")
    return sorted_.mapInArrow(_link_task(limit), "a long, b long")


def classes(signed: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(fp, root) for the fingerprints that have a near neighbour; ``signed`` has a column fp."""
    members = signed.select("fp").distinct()
    return connected_components(link(members, limit))


def components(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the component) of every row."""
    signed = settle(fingerprints(docs, "doc_id", shingle=shingle), "simhash-signed")
    members = settle(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-members")
    linked = settle(classes(members, limit), "simhash-classes")
    rooted = members.join(linked, members.fp == linked.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = settle(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    named = settle(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return signed.join(named, "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, limit: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one per component: that with the smallest doc_id (rows
    without one last; ties by a hash of the whole row; of equal rows, one)."""
    keyed = keyed_rows(docs)
    texts = keyed.select("_row_a", "_row_b", "row.doc_id", "row.text")
    signed = settle(fingerprints(texts, "doc_id", "_row_a", "_row_b", shingle=shingle), "simhash-signed")
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row_a", "_row_b")
    members = settle(signed.groupBy("fp").agg(F.min(rank).alias("first")), "simhash-members")
    linked = settle(classes(members, limit), "simhash-classes")
    kept = (members.join(linked, members.fp == linked.node, "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select("first._row_a", "first._row_b"))
    chosen = keyed.join(settle(kept, "simhash-kept"), ["_row_a", "_row_b"], "left_semi")
    release(signed)
    return chosen.dropDuplicates(["_row_a", "_row_b"]).select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
