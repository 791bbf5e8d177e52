"""Fill-in-the-middle transformation (operator 13).

A text is cut into prefix, middle and suffix at two keyed code points and
written in the order its form names. Where these code points lie in the bytes
comes from content-defined chunks:

* a rolling hash over the last 32 bytes ends a chunk wherever its low bits are
  zero, so equal passages fall into equal chunks in whatever document, at
  whatever place;
* each chunk has a boundary summary: its code points, whether it holds a mark,
  and its first and last two bytes (a mark that straddles chunks is seen when
  two summaries are joined). A cache keeps summaries of chunks already met; a
  hit counts only if the bytes are equal;
* running sums of the chunks' counts give the text's length and the chunk that
  holds a cut; only that chunk is looked into.

The cache belongs to a task and is bounded (``CACHE_BYTES``); results do not
depend on what it holds, so a lost task is simply run again. One pass over the
rows, no shuffle.

Defined cases: null is read as an empty text (plain, 0 code points); a null
doc_id has the key ``1:``; rows that share a doc_id share their draws; an empty
table gives an empty result; other columns travel as one struct and cannot
clash; texts of any length are handled as bytes, in segments.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import table, whole_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = re.compile(b"<[PSM]>")
#: shares of the forms, in percent
TRANSFORMED, SUFFIX_FIRST = 90, 20

#: chunk lengths in bytes: none below, about LEAST + MEAN on average, none above
LEAST, MEAN, MOST = 128, 1024, 16_384
SEGMENT = 1 << 20
CACHE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
REACH = 32


def _gear() -> np.ndarray:
    """256 pseudorandom 32-bit words (splitmix64 of the byte)."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < REACH of GEAR[data[i - j]] << j (mod 2^32), by doubling the reach."""
    h = GEAR[data]
    reach = 1
    while reach < REACH:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def ends(text: bytes) -> list[int]:
    """Where chunks end (the last at the text's end), always between two code points."""
    data = np.frombuffer(text, np.uint8)
    found = []
    for at in range(0, len(text), SEGMENT):
        before = max(0, at - REACH + 1)
        h = rolling(data[before : at + SEGMENT])[at - before :]
        found.append(np.flatnonzero((h & np.uint32(MEAN - 1)) == 0) + at + 1)
    starts_point = lambda i: i >= len(text) or text[i] & 0xC0 != 0x80
    out, last = [], 0

    def forced(until):
        """Ends where the hash offers none for MOST bytes."""
        nonlocal last
        while until - last > MOST:
            cut = last + MOST
            while not starts_point(cut):
                cut -= 1
            out.append(cut)
            last = cut

    for end in np.concatenate(found).tolist() if found else ():
        if end - last >= LEAST and starts_point(end):
            forced(end)
            out.append(end)
            last = end
    forced(len(text))
    if last < len(text):
        out.append(len(text))
    return out


class Summary(NamedTuple):
    points: int  # code points
    marked: bool  # holds a mark
    head: bytes  # first two bytes
    tail: bytes  # last two


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    points = len(chunk) if chunk.isascii() else int(np.count_nonzero((data & 0xC0) != 0x80))
    return Summary(points, MARK.search(chunk) is not None, chunk[:2], chunk[-2:])


def joined(a: Summary, b: Summary) -> Summary:
    """The summary of two neighbours, from their summaries alone."""
    across = MARK.search(a.tail + b.head) is not None
    return Summary(a.points + b.points, a.marked or b.marked or across, (a.head + b.head)[:2], (a.tail + b.tail)[-2:])


class Cache:
    """Summaries by the chunk's hash; an entry answers only for equal bytes. The oldest go first."""

    def __init__(self, bound: int = CACHE_BYTES, fingerprint=hash):
        self.bound, self.held, self.fingerprint = bound, 0, fingerprint
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.hits = self.misses = 0

    def __call__(self, chunk: bytes) -> Summary:
        key = self.fingerprint(chunk)
        entry = self.known.pop(key, None)
        if entry is not None and entry[0] == chunk:
            self.hits += 1
        else:
            self.misses += 1
            self.held += len(chunk) - (len(entry[0]) if entry else 0)
            entry = (chunk, summary(chunk))
        self.known[key] = entry  # the youngest
        while self.held > self.bound:
            self.held -= len(self.known.pop(next(iter(self.known)))[0])
        return entry[1]


class Chunked:
    """A text as chunks: its code points, whether it holds a mark, and where its n-th code point lies."""

    def __init__(self, text: bytes, cache: Cache):
        self.text, self.ends = text, ends(text)
        parts = [cache(text[a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.before = [0, *accumulate(p.points for p in parts)]
        self.points = self.before[-1]
        whole = parts[0] if parts else Summary(0, False, b"", b"")
        for p in parts[1:]:
            whole = joined(whole, p)
        self.marked = whole.marked

    def byte_of(self, point: int) -> int:
        """Bytes before code point ``point`` (0 to ``points``)."""
        if point >= self.points:
            return len(self.text)
        k = bisect_right(self.before, point) - 1
        start, inside = (self.ends[k - 1] if k else 0), point - self.before[k]
        if self.before[k + 1] - self.before[k] == self.ends[k] - start:
            return start + inside  # one byte a code point
        data = np.frombuffer(self.text, np.uint8, self.ends[k] - start, start)
        return start + int(np.flatnonzero((data & 0xC0) != 0x80)[inside])


def transformed(text: bytes, draws: tuple[int, int, int, int], cache: Cache):
    """(code points, form, prefix_chars, middle_chars, output)."""
    t = Chunked(text, cache)
    n = t.points
    h1, h2, h3, h4 = draws
    if not n or t.marked or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, to = t.byte_of(a), t.byte_of(b)
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def draws_key(seed: int = 1) -> Column:
    """32 hex digits: the four draws of a document."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 32)


OUT = "n long, form string, prefix_chars long, middle_chars long, fim_text string"


def _task(batches) -> Iterator:
    import pyarrow as pa

    cache = Cache()

    def batch(row, rows):
        n, form, a, m, text = map(list, zip(*rows)) if rows else ([], [], [], [], [])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [row, *map(pa.array, (n, form, a, m), kinds), pa.array(text, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["row", "n", "form", "prefix_chars", "middle_chars", "fim_text"])

    for b in batches:
        texts, keys = b.column(2).cast(pa.binary()), b.column(1).to_pylist()
        rows, size, first = [], 0, 0
        for i, key in enumerate(keys):
            draws = tuple(int(key[8 * j : 8 * j + 8], 16) for j in range(4))
            rows.append(transformed(texts[i].as_py(), draws, cache))
            size += len(rows[-1][-1])
            if size >= BATCH_BYTES:
                yield batch(b.column(0).slice(first, len(rows)), rows)
                rows, size, first = [], 0, i + 1
        yield batch(b.column(0).slice(first, len(rows)), rows)


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``row`` (every column but the text, as a struct) and OUT: code points, form, lengths of
    prefix and middle (null if plain), and the text in its new order. :func:`restored` gives
    the text back."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    picked = docs.select(F.struct(*others).alias("row"), draws_key(seed).alias("key"), whole_text().alias("text"))
    kind = picked.schema["row"].dataType.simpleString()
    return picked.mapInArrow(_task, f"row {kind}, {OUT}")


def restored(text: Column, form: Column) -> Column:
    """The text before the transformation, from its output and form."""
    parts = F.split(text, "<[PSM]>", -1)  # empty, then three parts in their order; no part holds a mark
    part = lambda i: F.element_at(parts, i)
    return (F.when(form == "psm", F.concat(part(2), part(4), part(3)))
            .when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(text))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars",
                       digest(F.col("fim_text")).alias("output_sha256"),
                       digest(restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))
