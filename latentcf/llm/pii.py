"""Personal data by bootstrapped contextual extraction (operator 1).

Seeds: e-mail addresses, IP addresses, payment cards and phone numbers found by
their form ("base" spans). The words around a seed are lexical patterns; words
and numbers that only look a little like an identifier are candidates. Both
meet in a graph of patterns and instances, which Spark scores in rounds:

  pattern  = summed confidence of its instances / (its instances + 1)
  instance = 1 - product over its patterns of (1 - pattern)

Seeds keep the confidence 1. A pattern counts once it has LEAST_INSTANCES
instances and the confidence LEAST_CONFIDENCE, and then lends confidence to the
candidates it surrounds, which may support further patterns in the next round.
Candidates over LEAST_CONFIDENCE add spans of their pattern's kind.

The graph is kept as distinct edges with all of its sums pre-aggregated; no
pattern's or instance's edges are gathered. Offsets are code points, end
exclusive.

Defined cases: null is read as an empty text; documents without spans have
empty strings; repeated rows and rows sharing a doc_id each give their row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import release, settle, table, whole_text

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_INSTANCES = 3
LEAST_CONFIDENCE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: every ip, card and phone match begins with its first character and lies inside one of these
_NUMERIC = re.compile(r"[0-9+][0-9+().\x20-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORDS_BEFORE, _WORDS_AFTER = 96, 48


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, searched from each @ so that
    long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind number, end) of all base spans in order, and the numeric runs of the text."""
    out = [(s, 0, e) for s, e in emails(text)]
    runs = []
    for run in _NUMERIC.finditer(text):
        lo, part = run.start(), run.group()
        runs.append((lo, run.end()))
        if len(part) < 7:
            continue
        for m in _IP.finditer(part):
            if all(map(_small, m.group().split("."))):
                out.append((lo + m.start(), 1, lo + m.end()))
        for m in _CARD.finditer(part):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((lo + m.start(), 2, lo + m.end()))
        for m in _PHONE.finditer(part):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((lo + m.start(), 3, lo + m.end()))
    return sorted(out), runs


def _kinds_like(value: str) -> list[int]:
    """Kinds that a candidate could be, by a form much looser than the seeds'."""
    digits = sum(c.isdigit() for c in value)
    out = [0] if "@" in value[1:-1] else []
    if re.fullmatch(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}|[0-9]+(?:\.[0-9]+){3}", value):
        out.append(1)
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9][0-9 .-]*", value):
        out.append(2)
    if 7 <= digits <= 15 and re.fullmatch(r"[0-9(][0-9 ().-]*", value):
        out.append(3)
    return out


def candidates(text: str, base, runs) -> list[tuple[int, int, str, int]]:
    """(start, end, value, kind number) of words and numeric runs that look like an identifier."""
    spots = [(lo, hi) for lo, hi in runs if hi - lo >= 5]
    at = text.find("@")
    while at >= 0:
        spots.append((at, at + 1))
        at = text.find("@", at + 1)
    out, reach, taken = [], -1, 0
    for lo, hi in sorted(spots):
        if lo < reach:
            continue
        while lo < hi and text[hi - 1] in " .(-+":
            hi -= 1
        if lo and text[lo - 1] == "(" and ")" in text[lo:hi]:
            lo -= 1
        glued = (lo > 0 and not text[lo - 1].isspace() and text[lo - 1] not in "([\"'") or (
            hi < len(text) and not text[hi].isspace() and text[hi] not in ".,;:!?)]\"'")
        if glued:  # part of a longer word: the word is the candidate, if it is no longer than one may be
            while lo > 0 and hi - lo <= 256 and not text[lo - 1].isspace():
                lo -= 1
            while hi < len(text) and hi - lo <= 256 and not text[hi].isspace():
                hi += 1
            while lo < hi and text[lo] in "\"'([<":
                lo += 1
            while lo < hi and text[hi - 1] in ".,;:!?\"')]>":
                hi -= 1
        reach = hi
        while taken < len(base) and base[taken][2] <= lo:
            taken += 1
        if hi - lo < 5 or hi - lo > 256 or any(s < hi and lo < e for s, _, e in base[taken : taken + 8]):
            continue
        value = text[lo:hi]
        out.extend((lo, hi, value.lower(), k) for k in _kinds_like(value))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: two words before it, and one on each side."""
    def words(part):
        return [w for w in (w.strip(".,;:!?\"'()[]").lower() for w in part.split()) if w]

    left, right = words(text[max(0, start - _WORDS_BEFORE) : start])[-2:], words(text[end : end + _WORDS_AFTER])[:1]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def _scan_task(batches):
    import pyarrow as pa

    spans = pa.list_(pa.struct([("start", pa.int64()), ("no", pa.int32()), ("end", pa.int64())]))
    edges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("no", pa.int32()),
                                ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        found, around = [], []
        for text in b.column(1).to_pylist():
            base, runs = base_spans(text)
            found.append([{"start": s, "no": k, "end": e} for s, k, e in base])
            one = [{"start": s, "end": e, "value": text[s:e].lower(), "no": k, "seed": True, "patterns": patterns(text, s, e)}
                   for s, k, e in base]
            one += [{"start": s, "end": e, "value": v, "no": k, "seed": False, "patterns": patterns(text, s, e)}
                    for s, e, v, k in candidates(text, base, runs)]
            around.append([x for x in one if x["patterns"]])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans), pa.array(around, edges)],
                                         names=["doc_id", "base", "around"])


_SCAN = ("doc_id long, base array<struct<start:long,no:int,end:long>>, around array<struct<start:long,end:long,"
         "value:string,no:int,seed:boolean,patterns:array<string>>>")


def seeds(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, around) of every document, written; ``row`` is unique."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return settle(picked.mapInArrow(_scan_task, _SCAN).withColumn("row", F.monotonically_increasing_id()), "pii-scan")


def score_graph(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, no, confidence) of candidate instances over LEAST_CONFIDENCE; ``mentions`` has
    value, no, seed and patterns."""
    edges = settle(mentions.select("value", "no", "seed", F.explode("patterns").alias("pattern"))
                   .groupBy("pattern", "value", "no").agg(F.max("seed").alias("seed")), "pii-edges")
    known = edges.withColumn("confidence", F.col("seed").cast("double")).drop("seed")
    out = None
    for _ in range(rounds):
        strong = (known.groupBy("pattern", "no")
                  .agg((F.sum("confidence") / (F.count("*") + 1)).alias("strength"), F.sum("confidence").alias("support"))
                  .where((F.col("support") >= LEAST_INSTANCES) & (F.col("strength") >= LEAST_CONFIDENCE))
                  .select("pattern", "no", "strength"))
        strong = settle(strong, "pii-patterns")
        lent = (edges.where(~F.col("seed")).join(strong, ["pattern", "no"])
                .groupBy("value", "no").agg((1 - F.exp(F.sum(F.log1p(-F.col("strength"))))).alias("confidence")))
        last, out = out, settle(lent, "pii-instances")
        for t in (strong, last):
            if t is not None:
                release(t)
        known = (edges.join(out, ["value", "no"], "left")
                 .select("pattern", "value", "no",
                         F.when(F.col("seed"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence")))
    return out.where(F.col("confidence") >= LEAST_CONFIDENCE)


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of struct(start, no, end); spans holds the base ones too)."""
    found = seeds(docs)
    mentions = found.select("row", F.explode("around").alias("m")).select("row", "m.*")
    sure = settle(score_graph(mentions), "pii-sure")
    added = (mentions.where(~F.col("seed")).join(sure, ["value", "no"])
             .groupBy("row").agg(F.collect_set(F.struct("start", "no", "end")).alias("added")))
    added = settle(added, "pii-added")
    joined = found.drop("around").join(added, "row", "left")
    nothing = F.expr("cast(array() as array<struct<start:long,no:int,end:long>>)")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", nothing))).alias("spans"))


def written(spans):
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["no"] + 1), s["start"], s["end"])), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
