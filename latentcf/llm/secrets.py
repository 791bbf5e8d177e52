"""Secret scan (operator 9), DataFrame functions only.

Base spans come from three patterns. The method adds spans of high-entropy
strings: over each candidate a window of WINDOW characters slides, the
character counts inside it are kept up to date as one character enters and one
leaves, and with them the sum of c * log2(c), which gives the Shannon entropy.
The highest window is held against the limit of the candidate's character
class. Candidates on the allow-list, and those that touch a base span, add
nothing. The work grows with the text and its matches, not with their product.

Everything is one pass over each row: no shuffle, no Python. Offsets are code
points, end exclusive.

Defined cases: null is read as an empty text (no spans); repeated rows give
repeated rows; other columns are not read (``redact`` passes them through).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import let, table, whole_text

KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: kind -> (pattern, group 1: what is measured; least length). Matches that cannot
#: pass are left out of a pattern only where no other match could take their place.
BASE = {
    "assign": (rf"{KEYWORD}([A-Za-z0-9+/_.=-]+)", 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", 16),
    "hex": (r"((?<![0-9a-f])[0-9a-f]{32,})", 32),
}
KINDS = (*BASE, "entropy")

WINDOW = 20
#: a character that stands for those of base spans while candidates are looked for
MASK = "\x01"
CANDIDATE = r"(?<![A-Za-z0-9+/_\x01-])[A-Za-z0-9+/_\x01-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: character class -> (pattern of the whole candidate, least entropy in bits), first match decides
CLASSES = {
    "digits": (r"^[0-9+/_=-]+$", 3.2),
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "letters": (r"^[A-Za-z/_=-]+$", 4.0),
    "base64": (r"", 3.8),
}
#: candidates that are no secrets: UUIDs, documented example keys, one character repeated, paths of words
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?:AKIA[A-Z0-9]{9,}EXAMPLE|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY)$",
    r"^(.)\1+$",
    r"^/?[A-Za-z_-]+(?:/[A-Za-z0-9_-]{1,12}){2,16}/?$",
)


#: entries of an array that one fold goes through; folds of folds keep long arrays linear
STRIDE = 64


def running(items: Column, measure, combine, zero: int = 0) -> Column:
    """For each entry of an array, ``combine`` over the ``measure`` of all entries before it (whole
    numbers), in two levels: totals of strides first, then each stride from its own start."""
    none = F.expr("cast(array() as array<int>)")

    def each(array):
        n = F.size(array)
        strides = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STRIDE).cast("int"))).otherwise(none)
        places = lambda c: F.sequence(c * STRIDE + 1, F.least(n, (c + 1) * STRIDE))
        value = lambda i: measure(F.element_at(array, i)).cast("int")
        start = lambda at: F.struct(at.cast("int").alias("at"), none.alias("out"))
        noted = lambda acc, v: F.struct(combine(acc["at"], v).cast("int").alias("at"),
                                        F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        totals = F.transform(strides, lambda c: F.aggregate(places(c), F.lit(zero), lambda a, i: combine(a, value(i)).cast("int")))
        firsts = F.aggregate(totals, start(F.lit(zero)), noted, lambda acc: acc["out"])
        return let(firsts, lambda first: F.flatten(F.transform(strides, lambda c: F.aggregate(
            places(c), start(F.element_at(first, c + 1)), lambda acc, i: noted(acc, value(i)), lambda acc: acc["out"]))))

    return let(items, each)


def matches(text: Column, pattern: str) -> Column:
    """array of struct(start, end, found): the leftmost non-overlapping matches, with their
    places from the lengths of what lies between them."""
    between = F.split(text, pattern, -1)
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")
    zipped = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
                 lambda found: F.arrays_zip(found.alias("found"), F.slice(between, 1, F.size(found)).alias("before")))

    def placed(z):
        ahead = running(z, lambda x: F.length(x["before"]) + F.length(x["found"]), lambda a, b: a + b)

        def one(x, at):
            start = at + F.length(x["before"])
            return F.struct(start.alias("start"), (start + F.length(x["found"])).alias("end"), x["found"].alias("found"))

        return F.zip_with(z, ahead, one)

    return F.when(text.rlike(pattern), let(zipped, placed)).otherwise(nothing)


#: code points of a piece of text, when parts of it are taken out
PIECE = 1024


def replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with each span (struct with start and end, in order of their starts; overlapping ones as one
    place) written as ``mark(its code points)``. Parts are taken from pieces of the text, so that their cost
    does not grow with their place in it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))

    def part(cut, start, end):
        """Code points from start to before end."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        chunk = lambda i: F.element_at(cut, i + 1).substr(
            F.greatest(start - i * PIECE, F.lit(0)) + 1, F.least(end, (i + 1) * PIECE) - F.greatest(start, i * PIECE))
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), chunk), "")).otherwise("")

    def joined(cut, ordered):
        until = running(ordered, lambda s: s["end"], F.greatest)

        def written_out(s, at):
            # what lies ahead of the span, and the part of the span that no earlier one covers
            covered = s["end"] - F.greatest(s["start"], at)
            return F.when(s["end"] <= at, "").otherwise(F.concat(
                F.when(s["start"] >= at, part(cut, at, s["start"])).otherwise(""), mark(covered, s["start"] >= at)))

        done = F.array_join(F.zip_with(ordered, until, written_out), "")
        return F.concat(done, part(cut, F.array_max(F.transform(ordered, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, let(pieces, lambda cut: let(spans, lambda o: joined(cut, o)))).otherwise(text)


def base_spans(text: Column, kind: str) -> Column:
    pattern, least = BASE[kind]
    inner = pattern if kind == "assign" else None
    found = matches(text, pattern.replace("(", "(?:", 1) if kind != "assign" else pattern)
    if inner is None:
        return found  # the pattern itself asks for the length
    return F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], inner, 1)) >= least)


def max_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of any ``window`` characters, by incremental counts."""
    letters = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    weight = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]

    def entropy(codes, weights):
        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
                         F.lit(float("inf")).alias("least"))

        def step(acc, i):
            enters = F.element_at(codes, i)
            leaves = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            n_in = F.element_at(acc["counts"], enters)
            n_out = F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))
            gain = F.element_at(weights, n_in + 2) - F.element_at(weights, n_in + 1)
            loss = F.when(leaves > 0, F.element_at(weights, n_out + 1)
                          - F.element_at(weights, F.greatest(n_out, F.lit(1)))).otherwise(0.0)
            now = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + gain - loss)
            counts = F.transform(acc["counts"],
                                 lambda n, k: n + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
            return F.struct(counts.alias("counts"), now.alias("sum"),
                            F.when(i >= window, F.least(acc["least"], now)).otherwise(acc["least"]).alias("least"))

        # the sum of c*log2(c) falls as the entropy rises
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step,
                           lambda acc: math.log2(window) - acc["least"] / window)

    return let(letters, lambda codes: let(F.array(*[F.lit(w) for w in weight]), lambda weights: entropy(codes, weights)))


def _is_secret(candidate: Column) -> Column:
    limit = F.lit(None)
    for pattern, least in reversed(CLASSES.values()):
        limit = F.when(candidate.rlike(pattern), F.lit(least)).otherwise(limit) if pattern else F.lit(least)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, False).otherwise(max_entropy(candidate) >= limit)


def scan(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as a struct), the text (null as empty), n_<kind>, base and all spans as
    arrays of struct(start, kind number, kind, end), ordered."""

    def typed(spans, kind):
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"),
                                                     F.lit(kind).alias("kind"), m["end"].alias("end")))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text().alias("_text"))
    rows = rows.withColumns({f"_{k}": base_spans(F.col("_text"), k) for k in BASE})
    rows = rows.withColumn("_base", F.array_sort(F.concat(*[typed(F.col(f"_{k}"), k) for k in BASE])))
    # base spans are masked: a run of candidate characters that touches one holds the mask
    clear = F.translate(F.col("_text"), MASK, " ")
    rows = rows.withColumn("_masked", F.when(F.col("_text").rlike(CANDIDATE), replaced(
        clear, F.col("_base"), lambda n, _: F.repeat(F.lit(MASK), n))).otherwise(""))
    free = F.filter(matches(F.col("_masked"), CANDIDATE), lambda m: ~F.contains(m["found"], F.lit(MASK)))
    rows = rows.withColumn("_entropy", F.filter(free, lambda m: _is_secret(m["found"])))
    return rows.select("row", "_text",
                       *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "_base",
                       F.array_sort(F.concat("_base", typed(F.col("_entropy"), "entropy"))).alias("_spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with each secret's characters in ``text`` replaced by ``mark``
    (overlapping spans as one) and n_chars, where there is such a column, set to the new length."""
    names = docs.columns
    found = scan(docs)
    new = replaced(F.col("_text"), F.col("_spans"), lambda _, apart: F.when(apart, F.lit(mark)).otherwise(""))
    hit = F.size("_spans") > 0
    found = found.withColumn("_new", F.when(hit, new))
    changed = {"text": F.coalesce("_new", F.col("row.text"))}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(hit, F.length("_new").cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in names])


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", *[f"n_{k}" for k in BASE], F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
                        written(F.col("_spans")).alias("spans"), "n_entropy")
