"""Benchmark decontamination by canonical templates (operator 6), DataFrame functions only.

Texts are canonicalised: numbers, names (capitalised words inside a sentence)
and units after a number become typed placeholders; case and punctuation go.
Windows of WINDOW template words are hashed and joined with those of the
benchmark. A document and an item match when LEAST_COVERAGE of the item's
windows stand in the document or an unbroken passage of it of LEAST_PASSAGE
words (half of the item, if that is less) does, and, where the windows hold placeholders, each
value of the item stands for one value of the document throughout an aligned
occurrence (slot consistency), which catches re-parameterised questions and
leaves chance meetings of placeholders alone.

The windows' table of the benchmark is written first, so Spark knows its size
and broadcasts it only under its threshold; beyond it both sides are shuffled
by window hash.

Defined cases: null and empty texts have no windows and match nothing; an item
of fewer than WINDOW words is one window of its own length, which is looked for
in documents of any length (an item of one word is held by every document with
that word); windows with fewer than LEAST_LITERALS plain words are searched by
their own lower-case words only, and all other windows by these as well, so
copies are found in any case (``unsearchable`` lists the items of which only
copies are); equal rows give one row; rows sharing a doc_id are judged apart;
items sharing an item_id count as one item each by their text; other columns
are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latentcf.llm.common import keyed_rows, let, settle, table, whole_text

WINDOW = 8
LEAST_LITERALS = 5
LEAST_COVERAGE = 0.5
LEAST_CONSISTENCY = 0.75
#: words of an unbroken passage that are a match by themselves, whatever share of the item they are
LEAST_PASSAGE = 50
NUMBER, NAME, UNIT = "", "", ""

# Units that may follow a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hz", "kb", "mb", "gb", "tb",
         "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "ounce", "ounces", "pound", "pounds",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
         "metre", "metres", "meter", "meters", "litre", "litres", "gram", "grams", "ton", "tons")


def template_words(text: Column) -> Column:
    """Array of lower-case words; a placeholder's word is its mark followed by the value."""
    marks = NUMBER + NAME + UNIT
    edge = r"(?![\p{L}\p{N}])"
    t = F.translate(text, marks, "   ")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(\p{N}(?:[\p{N}.,]*\p{N})?)", f"{NUMBER}$1")
    t = F.regexp_replace(t, rf"({NUMBER}[\p{{N}}.,]+)\s?((?i:{'|'.join(UNITS)})){edge}", f"$1 {UNIT}$2")
    t = F.regexp_replace(t, rf"(?<=[\p{{Ll}}\p{{N}}][,;:]?\s)(\p{{Lu}}\p{{Ll}}+){edge}", f"{NAME}$1")
    t = F.regexp_replace(t, rf"[.,](?!\p{{N}})|(?<!\p{{N}})[.,]|[^\p{{L}}\p{{N}}.,{marks}]", " ")
    return F.filter(F.split(F.lower(t), " +"), lambda w: w != "")


def _is_slot(word: Column) -> Column:
    return (word >= NUMBER) & (word < chr(ord(UNIT) + 1))


def _template(word: Column) -> Column:
    return F.when(_is_slot(word), F.substring(word, 1, 1)).otherwise(word)


def _plain(word: Column) -> Column:
    return F.when(_is_slot(word), F.substring(word, 2, 2**31 - 1)).otherwise(word)


def window_hashes(words: Column, size: Column | int) -> Column:
    """array of struct(place, hash, raw) of every run of ``size`` words: the hash of its template and
    that of its words themselves, which are equal where the run holds no placeholder."""
    n = F.lit(size) if isinstance(size, int) else size

    def run(hashes, i):
        if isinstance(size, int):  # equal to the hash of the slice, without a copy of the array per window
            return F.xxhash64(*[F.element_at(hashes, i + j) for j in range(size)])
        return F.xxhash64(F.slice(hashes, i, n))

    def runs(hashes):
        starts = F.when(F.size(words) >= F.greatest(n, F.lit(1)), F.sequence(F.lit(1), F.size(words) - n + 1))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("place"), run(hashes["t"], i).alias("hash"),
                                                      run(hashes["r"], i).alias("raw")))

    return let(F.struct(F.transform(words, lambda w: F.xxhash64(_template(w))).alias("t"),
                        F.transform(words, lambda w: F.xxhash64(_plain(w))).alias("r")), runs)


def _windows(texts: DataFrame, keys: list[str], size: Column | int, slots: bool) -> DataFrame:
    """(keys, place, hash, raw [, slots, literals, length]) of every window; ``texts`` has the keys and column words."""
    n = F.lit(size) if isinstance(size, int) else size
    kept = texts.select(*keys, "words", F.explode(window_hashes(F.col("words"), size)).alias("w")).select(*keys, "words", "w.*")
    if not slots:
        return kept.drop("words")
    run = F.slice("words", F.col("place") + 1, n)
    return kept.select(*keys, "place", "hash", "raw", F.filter(run, _is_slot).alias("slots"),
                       F.size(F.filter(run, lambda w: ~_is_slot(w))).alias("literals"), F.size(run).alias("length"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, place, hash, raw, slots, literals, length), written; item is a hash of id and
    text; an item of fewer than ``window`` words is one window of its own length."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).distinct()
             .select("item_id", F.xxhash64(F.isnull("item_id"), "item_id", "text").alias("item"),
                     template_words(F.col("text")).alias("words")))
    size = F.least(F.size("words"), F.lit(window))
    return settle(_windows(items, ["item", "item_id"], size, slots=True), "benchmark-windows")


def unsearchable(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Items none of whose windows has LEAST_LITERALS plain words: only copies of their words are found."""
    found = benchmark_windows(benchmark, window)
    return found.groupBy("item", "item_id").agg(F.max("literals").alias("literals")).where(
        F.col("literals") < LEAST_LITERALS).select("item_id")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = LEAST_COVERAGE,
         consistency: float = LEAST_CONSISTENCY, passage: int = LEAST_PASSAGE) -> DataFrame:
    """One row per matching document and item: doc_id, item_id, matched, windows, coverage,
    consistency (1 where the match is word for word or holds no placeholders), and the row's keys."""
    all_windows = benchmark_windows(benchmark, window).withColumn("searched", F.col("literals") >= LEAST_LITERALS)
    before = Window.partitionBy("item").orderBy("place")
    all_windows = all_windows.withColumn("rank", F.sum(F.col("searched").cast("long")).over(before))
    searched = all_windows.where("searched")
    sizes = all_windows.groupBy("item").agg(F.count("*").alias("of"), F.sum(F.col("searched").cast("long")).alias("of_searched"),
                                            F.max(F.size("slots")).alias("slotted"))
    # windows that a passage of the length asked for has at least
    sizes = sizes.withColumn("run", F.greatest(F.least(F.lit(passage), F.ceil((F.col("of") + window - 1) / 2)) - window + 1, F.lit(1)))
    # the join's small side holds only what it needs: its true size decides on a broadcast
    place = ["item", "item_id", F.col("place").alias("item_place"), "searched", "rank"]
    probe = settle(searched.where("hash != raw").select("hash", *place, F.lit(False).alias("exact"))
                   .union(all_windows.select("raw", *place, F.lit(True))), "benchmark-probe")
    # only the lengths of items shorter than a window are looked for besides windows
    lengths = [window, *sorted(r.length for r in all_windows.where(F.col("length") < window).select("length").distinct().collect())]
    keys = ["_row_a", "_row_b", "doc_id"]
    words = keyed_rows(docs).select("_row_a", "_row_b", F.col("row.doc_id").cast("long").alias("doc_id"),
                                    template_words(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("words"))

    def windows(texts, slots):
        parts = [_windows(texts, keys, n, slots) for n in lengths]
        return reduce(DataFrame.unionByName, parts)

    either = F.when(F.col("hash") == F.col("raw"), F.array("hash")).otherwise(F.array("hash", "raw"))
    hits = windows(words, slots=False).select(*keys, "place", F.explode(either).alias("hash")).join(probe, "hash")
    hits = settle(hits.select(*keys, "item", "item_id", "item_place", "searched", "rank", "exact",
                              (F.col("place") - F.col("item_place")).alias("shift")), "decontaminate-hits")
    counted = (hits.groupBy(*keys, "item", "item_id", "item_place", "searched").agg(F.max("exact").alias("exact"))
               .groupBy(*keys, "item", "item_id")
               .agg(F.count("*").alias("matched"), F.sum(F.col("searched").cast("long")).alias("matched_searched"),
                    F.sum(F.col("exact").cast("long")).alias("copied")))
    # coverage of the windows that stand for their templates, or of all windows, whichever is more
    of_templates, of_all = F.col("matched_searched") / F.nullif(F.col("of_searched"), F.lit(0)), F.col("matched") / F.col("of")
    better = F.coalesce(of_templates > of_all, F.lit(False))
    near = (counted.join(sizes, "item")
            .select(*keys, "item", "item_id", "slotted", F.when(better, F.col("matched_searched")).otherwise(F.col("matched")).alias("matched"),
                    F.when(better, F.col("of_searched")).otherwise(F.col("of")).alias("windows"),
                    F.greatest(of_templates, of_all).alias("coverage"), "run", F.col("matched").alias("all_matched"),
                    (F.col("copied") / F.col("of") >= coverage).alias("copy"))
            .where((F.col("coverage") >= coverage) | (F.col("all_matched") >= F.col("run"))))
    near = settle(near, "decontaminate-counted")

    # unbroken passages of pairs under the coverage: windows in step at one shift; only windows that
    # are not searched by their templates may be missing between two
    one = ["_row_a", "_row_b", "item"]
    partly = near.where(F.col("coverage") < coverage).select(*one, "run")
    at = (hits.join(partly, one).groupBy(*one, "run", "shift", "item_place", "searched", "rank").agg(F.max("exact").alias("exact")))
    in_order = Window.partitionBy(*one, "shift").orderBy("item_place")
    missing = F.col("rank") - F.col("searched").cast("long") - F.lag("rank").over(in_order)
    pieces = at.withColumn("breaks", (F.coalesce(missing, F.lit(0)) > 0).cast("long")).withColumn("piece", F.sum("breaks").over(in_order))
    passages = (pieces.groupBy(*one, "run", "shift", "piece").agg(F.count("*").alias("n"))
                .where(F.col("n") >= F.col("run")).select(*one, "shift", F.lit(False).alias("exact")))
    copies = (at.where("exact").withColumn("piece", F.col("item_place") - F.row_number().over(in_order))
              .groupBy(*one, "run", "shift", "piece").agg(F.count("*").alias("n"))
              .where(F.col("n") >= F.col("run")).select(*one, "shift", F.lit(True).alias("exact")))
    passages = settle(passages.union(copies).groupBy(*one, "shift").agg(F.max("exact").alias("exact")), "decontaminate-passages")
    quoted = passages.groupBy(*one).agg(F.max("exact").alias("quoted"))
    near = settle(near.join(quoted, one, "left").where((F.col("coverage") >= coverage) | F.col("quoted").isNotNull())
                  .select(*keys, "item", "item_id", "slotted", "matched", "windows", "coverage",
                          (F.col("copy") | F.coalesce("quoted", F.lit(False))).alias("copy")), "decontaminate-near")

    # slots are read again only for documents near an item that has some
    slotted = near.where(F.col("slotted") > 0).where(~F.col("copy")).select("_row_a", "_row_b", "item")
    again = words.join(slotted.select("_row_a", "_row_b").distinct(), ["_row_a", "_row_b"], "left_semi")
    ours = windows(again, slots=True).select("_row_a", "_row_b", "hash", "place", F.col("slots").alias("ours"))
    theirs = searched.where(F.size("slots") > 0).select("hash", "item", F.col("place").alias("item_place"), F.col("slots").alias("theirs"))
    pairs = (ours.where(F.size("ours") > 0).join(theirs, "hash").join(slotted, ["_row_a", "_row_b", "item"], "left_semi")
             .select("_row_a", "_row_b", "item", (F.col("place") - F.col("item_place")).alias("shift"),
                     F.explode(F.arrays_zip("theirs", "ours")).alias("slot"))
             .groupBy("_row_a", "_row_b", "item", "shift", "slot").agg(F.count("*").alias("n")))
    by_value = pairs.groupBy("_row_a", "_row_b", "item", "shift", "slot.theirs").agg(
        F.max("n").alias("most"), F.sum("n").alias("n"))
    by_shift = by_value.groupBy("_row_a", "_row_b", "item", "shift").agg((F.sum("most") / F.sum("n")).alias("c"))
    # of pairs under the coverage, only the shifts of their passages count
    by_shift = (by_shift.join(near.select(*one, (F.col("coverage") < coverage).alias("partly")), one)
                .join(passages.select(*one, "shift", F.lit(True).alias("passage")), [*one, "shift"], "left")
                .where(~F.col("partly") | F.col("passage")))
    agreed = by_shift.groupBy(*one).agg(F.max("c").alias("consistency"))
    found = near.join(agreed, one, "left")
    return (found.withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
            .where(F.col("consistency") >= consistency)
            .select("doc_id", "item_id", "matched", "windows", "coverage", "consistency", "_row_a", "_row_b"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows that match no item, with all their columns."""
    found = settle(find(docs, benchmark, **limits).select("_row_a", "_row_b").distinct(), "decontaminate-found")
    return keyed_rows(docs).join(found, ["_row_a", "_row_b"], "left_anti").select("row.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row_a", "_row_b")
