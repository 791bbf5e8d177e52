"""Mixing sources to target weights (operator 12), DataFrame functions only.

The words of each source form one stream, in the keyed order of its documents,
cut into blocks of ``BLOCK`` words. Then

1. targets: the sources' shares by weight, none above ``LIMIT`` times its size
   (the excess is shared again until none is above);
2. each source's target becomes a number of block draws; where its blocks do
   not end on the target, the last drawn block is cut. The draws fall on the
   output shards by keyed uniform draws, so a source's counts over the shards
   are multinomial, given its total;
3. running sums of the counts number each shard's slots. A slot is mapped
   through the permutation of its source and epoch (swap-or-not rounds: a
   bijection on any number of blocks, no cycle walking) to a block index;
4. slots meet the documents' pieces of blocks by a hash join on the index.

Every draw is a function of names, ids and texts, so reruns agree whatever the
partitioning. Running sums take two levels (chunks of about the square root of
the rows), so no window group holds a hot source; a block has at most BLOCK
pieces and LIMIT slots, so no key of the join is hot.

Defined cases: a null or empty text has size 0 and nothing is taken; a null
source is a source, last in order; null doc_ids count as one value; rows that
are equal share a place in the order, and it does not matter which comes
first; a table without words has targets 0; an empty table gives an empty
result; other columns travel as one struct and cannot clash.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latentcf.llm.common import let, release, settle, table, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: the mix takes this share of all words, and no source (or document) more than LIMIT times
SHARE, LIMIT = Fraction(3, 2), 2
#: words of a block; blocks of a shard, on average; rounds of a permutation
BLOCK, SHARD, ROUNDS = 256, 4096, 32
SEED = 12
#: draws numbered from one row, and by one task
RUN, TASK = 1 << 12, 1 << 17


def _long(expression: str) -> Column:
    return F.expr(expression).cast("long")


def running(df: DataFrame, by: list[str], chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before it in its group ``by``, in
    the order of ``chunk`` and, inside a chunk, of ``order``. Only sums of chunks meet in a group."""
    df = df.withColumn("_value", value)
    sums = df.groupBy(*by, chunk).agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*by, chunk, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return df.join(first, [*by, chunk]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop(
        "_value", "_inside", "_ahead")


def _sized(docs: DataFrame, texts: bool = False) -> DataFrame:
    """row (all columns but the text), _source, _size (words) and _key (the order inside a source); _text if asked for."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                         F.md5(whole_text().cast("binary"))).cast("binary"))
    return docs.select(F.struct(*others).alias("row"), F.col("source").cast("string").alias("_source"),
                       F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("_size"), key.alias("_key"),
                       *([whole_text().alias("_text")] if texts else []))


def _numbered(sizes: DataFrame) -> DataFrame:
    """The sources with _no from 0 on, by code point, null last: ranges first, then numbers inside each."""
    order = [F.col("_source").isNull(), F.col("_source")]
    ranges = settle(sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    return running(ranges, [], "_range", order, F.lit(1), "_no").drop("_range")


def water_level(sources: DataFrame) -> Fraction:
    """The words a unit of weight gets, when no source may get more than LIMIT times its size."""
    total, weight = sources.agg(F.sum("_source_size"), F.sum("_weight")).first()
    taken, left = 0, weight or 0
    while left:
        level = (SHARE * total - LIMIT * taken) / left
        full = _above(level)
        now = sources.agg(F.coalesce(F.sum(F.when(full, F.col("_source_size"))), F.lit(0)),
                          F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0))).first()
        if tuple(now) == (taken, left):
            return level
        taken, left = now
    return Fraction(0)


def _above(level: Fraction) -> Column:
    """Whether the weight's share at this level is above the limit."""
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    whole = lambda n: F.lit(Decimal(n)).cast("decimal(20,0)")
    return exact("_weight") * whole(level.numerator) > exact("_source_size") * whole(LIMIT * level.denominator)


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (_source, _source_size) with _no, _weight and _target."""
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("_no") % len(WEIGHTS) + 1).cast("int"))
    rows = settle(_numbered(sources).withColumn("_weight", pick.cast("long")), "mix-sources")
    level = water_level(rows)
    share = (F.col("_weight") * level.numerator).cast("double") / F.lit(float(level.denominator))
    return rows.withColumn("_target", F.when(_above(level), (F.col("_source_size") * LIMIT).cast("double")).otherwise(share))


def _round_keys(label: Column, blocks: Column, seed: int) -> Column:
    """For each epoch an array of struct(k, a, b, c), one per round: a shift below ``blocks`` and
    three 28-bit factors."""
    def one(epoch: Column, r: Column) -> Column:
        digits = F.md5(F.concat_ws("|", F.lit(seed), label, epoch, r).cast("binary"))
        number = lambda d, start, n: F.conv(F.substring(d, start, n), 16, 10).cast("long")
        return let(digits, lambda d: F.struct((number(d, 1, 11) % F.greatest(blocks, F.lit(1))).alias("k"),
                                              *[number(d, start, 7).alias(n) for start, n in ((12, "a"), (19, "b"), (26, "c"))]))
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(numbers(LIMIT), lambda e: F.transform(numbers(ROUNDS), lambda r: one(e, r)))


def permuted(place: Column, keys: Column, n: Column) -> Column:
    """Swap-or-not: in each round, ``place`` and its partner k - place (mod n) change places or
    not, by a bit that is the same for both. Each round undoes itself, so the rounds taken
    backwards (``keys`` reversed) are the inverse."""
    low = (1 << 30) - 1

    def step(x, q):
        partner = (q["k"] - x + n) % n
        higher = F.greatest(x, partner)
        mixed = (higher.bitwiseAND(low) * q["a"] + F.shiftright(higher, 30) * q["b"] + q["c"]) % 2147483647
        bit = F.shiftright((mixed * mixed + q["c"]) % 2147483647, 15).bitwiseAND(1)
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(keys, place, step)


def plan(sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The sources with _blocks, _keys (per epoch), _draws and _cut, the words kept of the last draw
    (null: all of it). The words drawn are the target, rounded."""
    rows = sources.withColumns({
        "_blocks": _long(f"(_source_size + {block - 1}) div {block}"),
        "_words": F.least(F.floor(F.col("_target") + 0.5), F.col("_source_size") * LIMIT).cast("long"),
        "_label": F.coalesce(F.concat(F.lit("s:"), F.col("_source")), F.lit("null"))})
    rows = rows.withColumn("_keys", _round_keys(F.col("_label"), F.col("_blocks"), seed))
    some = F.col("_source_size") > 0
    rows = rows.withColumns({"_epochs": F.when(some, _long("_words div greatest(_source_size, 1L)")).otherwise(F.lit(0)),
                             "_rest": F.when(some, F.col("_words") % F.greatest("_source_size", F.lit(1))).otherwise(F.lit(0))})
    # where the stream's last, shorter block stands in the epoch that is taken in part
    backwards = F.reverse(F.element_at("_keys", F.least(F.col("_epochs") + 1, F.lit(LIMIT)).cast("int")))
    rows = rows.withColumns({"_short_at": F.when(some, permuted(F.col("_blocks") - 1, backwards, F.col("_blocks"))),
                             "_short": F.col("_source_size") - (F.col("_blocks") - 1) * block})
    rows = rows.withColumn("_beyond", F.col("_rest") - F.col("_short_at") * block)  # words wanted from the short block on
    up = lambda c: f"(({c}) + {block - 1}) div {block}"
    slots = (F.when(F.col("_rest") == 0, F.lit(0)).when(F.col("_beyond") <= 0, F.expr(up("_rest")))
             .when(F.col("_beyond") <= F.col("_short"), F.col("_short_at") + 1)
             .otherwise(F.col("_short_at") + 1 + F.expr(up("_beyond - _short"))))
    before = lambda c: F.col(c) - (F.expr(up(c)) - 1) * block
    rows = rows.withColumn("_after", F.col("_beyond") - F.col("_short"))
    cut = (F.when(F.col("_rest") == 0, F.lit(None)).when(F.col("_beyond") <= 0, before("_rest"))
           .when(F.col("_after") <= 0, F.col("_beyond")).otherwise(before("_after")))
    return rows.select("_no", "_source", "_source_size", "_target", "_blocks", "_keys",
                       (F.col("_epochs") * F.col("_blocks") + slots).cast("long").alias("_draws"), cut.cast("long").alias("_cut"))


def shard_counts(sources: DataFrame, shards: int, tasks: int, seed: int = SEED) -> DataFrame:
    """(_no, _shard, _count): how many of its draws each source has in each output shard."""
    runs = sources.where("_draws > 0").select("_no", "_draws", F.explode(_steps("0L", "_draws - 1", RUN)).alias("_from"))
    draws = runs.repartition(tasks, "_no", "_from").select(
        "_no", F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, F.col("_draws")) - 1)).alias("_draw"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "_no", "_draw"), F.lit(shards))
    return draws.groupBy("_no", shard.alias("_shard")).agg(F.count("*").alias("_count"))


def _steps(first: str, last: str, step: int) -> Column:
    return F.expr(f"sequence({first}, {last}, {step}L)")


def slots(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD, seed: int = SEED) -> DataFrame:
    """(_no, _index, _shard, _slot, _kept): the blocks drawn, the shard each belongs to, its slot
    among its source's draws, and how many of its words, from the first on, the mix takes."""
    total = sources.agg(F.sum("_draws")).first()[0] or 0
    shards, tasks = max(1, math.ceil(total / shard_blocks)), max(1, math.ceil(total / TASK))
    width = max(1, math.isqrt(shards))
    counts = settle(shard_counts(sources, shards, tasks, seed), "mix-counts").withColumn("_chunk", _long(f"_shard div {width}"))
    cells = running(counts, ["_no"], "_chunk", ["_shard"], F.col("_count"), "_first").select("_no", "_shard", "_first", "_count")
    cells = cells.repartition(tasks, "_no", "_shard").join(sources, "_no")
    one = cells.select("_no", "_shard", "_blocks", "_source_size", "_keys", "_draws", "_cut",
                       F.explode(F.sequence("_first", F.col("_first") + F.col("_count") - 1)).alias("_slot"))
    keys = F.element_at("_keys", _long("_slot div _blocks").cast("int") + 1)
    one = one.withColumn("_index", permuted(F.col("_slot") % F.col("_blocks"), keys, F.col("_blocks")))
    whole = F.least(F.lit(block), F.col("_source_size") - F.col("_index") * block)
    last = (F.col("_slot") == F.col("_draws") - 1) & F.col("_cut").isNotNull()
    return one.select("_no", "_index", "_shard", "_slot", F.when(last, F.col("_cut")).otherwise(whole).cast("long").alias("_kept"))


def _first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text that starts with a word, and the white space among and after them."""
    pattern = F.concat(F.lit(r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), n, F.lit("}+"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """(_no, _start, _index, _low, _high): the documents' words in each block, as places in the
    block; with _run, these words, where ``placed`` has the texts."""
    first, last = f"_start div {block}", f"(_start + _size - 1) div {block}"
    rows, kept = placed.where("_size > 0"), ["_no", "_start", "_index"]
    if "_text" in placed.columns:
        # one pass over the text: the words up to the next block, then runs of whole blocks
        clean = F.regexp_replace("_text", r"^[\x20\x09-\x0D]+", "")
        ahead = F.least(F.col("_size"), block - F.col("_start") % block)
        rows = rows.select("_no", "_start", "_size", let(clean, lambda t: let(_first_words(t, ahead), lambda h: F.concat(
            F.array(h), F.regexp_extract_all(t.substr(F.length(h) + 1, F.length(t)),
                                             F.lit(rf"((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{1,{block}}}+)"), F.lit(1))))).alias("_runs"))
        rows = rows.select("_no", "_start", "_size", F.posexplode("_runs").alias("_at", "_run"))
        rows = rows.withColumn("_index", _long(f"{first} + _at"))
        kept = [*kept, "_run"]
    else:
        rows = rows.select("_no", "_start", "_size", F.explode(F.expr(f"sequence({first}, {last})")).alias("_index"))
    base = F.col("_index") * block
    return rows.select(*kept, (F.greatest(F.col("_start"), base) - base).alias("_low"),
                       (F.least(F.col("_start") + F.col("_size"), base + block) - base).alias("_high"))


class Mix:
    """A mix of ``docs`` (columns doc_id, source, text and any others). ``texts``: keep them, for :meth:`blocks`."""

    def __init__(self, docs: DataFrame, texts: bool = False, block: int = BLOCK, shard_blocks: int = SHARD, seed: int = SEED):
        self.block, self.shard_blocks, self.seed = block, shard_blocks, seed
        sized = settle(_sized(docs, texts), "mix-sized")
        sizes = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
        self.sources = settle(plan(targets(sizes), block, seed), "mix-plan")
        chunks = max(1, math.isqrt(sized.count()))
        place = F.conv(F.substring("_key", 1, 10), 16, 10).cast("long")
        named = sized.join(self.sources.select("_no", F.col("_source").alias("_name"), "_source_size", "_target"),
                           F.col("_source").eqNullSafe(F.col("_name"))).drop("_name", "_source")
        some = named.where("_size > 0").withColumn("_chunk", F.shiftright(place * chunks, 40))
        some = running(some, ["_no"], "_chunk", ["_key"], F.col("_size"), "_start")
        kept = ["row", "_no", "_size", "_start", "_source_size", "_target"] + ["_text"] * texts
        none = named.where("_size = 0").withColumn("_start", F.lit(None).cast("long"))
        self.placed = settle(some.select(*kept).union(none.select(*kept)), "mix-placed")
        release(sized)

    def pieces(self) -> DataFrame:
        """The mix itself: (_no, _start: the document; shard and slot; at: place in the block;
        first, words: which words of the document stand there), and their text where texts are kept."""
        drawn = slots(self.sources, self.block, self.shard_blocks, self.seed)
        met = _pieces(self.placed, self.block).join(drawn, ["_no", "_index"])
        met = met.withColumn("words", F.least("_high", "_kept") - F.col("_low")).where("words > 0")
        text = [F.rtrim(F.regexp_replace(_first_words(F.col("_run"), F.col("words")), r"[\x20\x09-\x0D]+", " ")).alias("text")]
        return met.select("_no", "_start", F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_low").alias("at"),
                          F.greatest(F.lit(0), F.col("_index") * self.block - F.col("_start")).alias("first"), "words",
                          *(text if "_run" in met.columns else []))

    def blocks(self) -> DataFrame:
        """(shard, source, slot, words, text): the mix's blocks, words joined by blanks. At most
        BLOCK pieces meet in a block."""
        block = self.pieces().groupBy("_no", "shard", "slot").agg(
            F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
        return block.join(self.sources.select("_no", F.col("_source").alias("source")), "_no").select(
            "shard", "source", "slot", "words", F.array_join("parts.text", " ").alias("text"))

    def documents(self) -> DataFrame:
        """``row`` (every column but the text), size, source_size, target and taken, one row per document."""
        sums = self.pieces().groupBy("_no", "_start").agg(F.sum("words").alias("_taken"))
        some = self.placed.where("_size > 0").join(sums, ["_no", "_start"], "left")
        none = self.placed.where("_size = 0").withColumn("_taken", F.lit(0).cast("long"))
        names = ["row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                 F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken")]
        return some.select(*names).union(none.select(*names))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.documents().select("row.doc_id", "size", "source_size", "target", "taken")
