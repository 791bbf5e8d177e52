"""Mixing sources to target weights (operator 12) against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from latentcf.llm import mixing
from latentcf.llm.common import table
from tests.conftest import SF0001
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def slow_targets(sizes):
    """source -> target, by sharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s for s in rest if share[s] > 2 * sizes[s]}
        if not above:
            return {s: Fraction(2 * sizes[s]) if s in full else share[s] for s in names}
        full |= above


def slow_permutation(source, epoch, n, seed=mixing.SEED):
    label = "null" if source is None else f"s:{source}"
    places = list(range(n))
    for r in range(mixing.ROUNDS):
        h = md5(f"{seed}|{label}|{epoch}|{r}")
        k, a, b, c = int(h[:11], 16) % n, int(h[11:18], 16), int(h[18:25], 16), int(h[25:32], 16)
        for i, x in enumerate(places):
            y = (k - x) % n
            top = max(x, y)
            m = ((top & (2**30 - 1)) * a + (top >> 30) * b + c) % (2**31 - 1)
            if ((m * m + c) % (2**31 - 1)) >> 15 & 1:
                places[i] = y
    assert sorted(places) == list(range(n))
    return places


def slow(rows, block=mixing.BLOCK):
    """[(doc_id, size, source_size, target, taken)] and the mix: (source, slot) -> words."""
    docs = defaultdict(list)
    for i, source, text in rows:
        docs[source].append((md5(("" if i is None else str(i)) + ":" + md5(text or "")), i, WORD.findall(text or "")))
    sizes = {s: sum(len(w) for _, _, w in d) for s, d in docs.items()}
    out, mix, targets = [], {}, slow_targets(sizes)
    for s, d in docs.items():
        d.sort(key=lambda x: x[0])
        owner = [j for j, (_, _, w) in enumerate(d) for _ in w]
        stream = [w for _, _, ws in d for w in ws]
        left, slot, n = min(int(targets[s] + Fraction(1, 2)), 2 * sizes[s]), 0, -(-len(stream) // block)
        taken = Counter()
        for epoch in (0, 1):
            for b in slow_permutation(s, epoch, n) if n and left else ():
                words = range(b * block, min(len(stream), (b + 1) * block))[:left]
                if not words:
                    break
                taken.update(owner[p] for p in words)
                mix[s, slot] = [stream[p] for p in words]
                slot, left = slot + 1, left - len(words)
        out += [(i, len(w), sizes[s], float(targets[s]), taken[j]) for j, (_, i, w) in enumerate(d)]
    return sorted(out, key=repr), mix


def rows_of(docs):
    return [(r.doc_id, r.source, r.text) for r in docs.collect()]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_op12_against_brute_force(spark):
    assert got(mixing.op12_mixing(spark, SF0001)) == slow(rows_of(table(spark, SF0001, "documents")))[0]


def odd(spark, seed=1):
    """Documents of sources of very different sizes, with odd rows."""
    rng = random.Random(seed)
    texts = list(cases.ODD) + [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 400))) for _ in range(150)]
    names = [None, "", "a", "Z", "é", "b", "b", "b", "z\U0001F600", "￮"]
    docs = cases.documents(spark, texts, extra=True, ids=[*cases.ODD_IDS, *(i % 140 for i in range(150))])
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.hash("doc_id", "text"), F.lit(len(names))) + 1).cast("int"))
    return docs.withColumn("source", pick)


@pytest.mark.parametrize("block, shard", [(256, 4096), (16, 8), (3, 5000)])
def test_odd_rows_against_brute_force(spark, block, shard, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    monkeypatch.setattr(mixing, "TASK", 30_000)
    docs = odd(spark)
    mix = mixing.Mix(docs, texts=True, block=block, shard_blocks=shard)
    expected, blocks = slow(rows_of(docs), block)
    done = mix.documents()
    assert {"row", "fp", "_text", "score"} <= set(done.schema["row"].dataType.names)
    assert got(done.select("row.doc_id", "size", "source_size", "target", "taken")) == expected
    made = mix.blocks().collect()
    assert {(r.source, r.slot): r.text for r in made} == {k: " ".join(w) for k, w in blocks.items()}
    assert all(r.words == len(blocks[r.source, r.slot]) for r in made) and len(made) == len(blocks)


def test_targets_are_met_and_nothing_is_taken_three_times(spark):
    rows = got(mixing.op12_mixing(spark, SF0001))
    docs = {r.doc_id: r.source for r in table(spark, SF0001, "documents").collect()}
    taken, target = Counter(), {}
    for i, size, _, t, n in rows:
        taken[docs[i]] += n
        target[docs[i]] = t
        assert n <= 2 * size
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_reruns_agree_whatever_the_partitioning(spark):
    docs = odd(spark)
    one = got(mixing.Mix(docs.coalesce(1)).documents().drop("row"))
    assert one == got(mixing.Mix(docs.repartition(7)).documents().drop("row"))


def test_shard_counts_are_multinomial(spark):
    sources = spark.createDataFrame([(0, 40_000), (1, 4_000), (2, 0)], "_no long, _draws long")
    counts = {(r._no, r._shard): r._count for r in mixing.shard_counts(sources, 8, 3).collect()}
    assert sum(n for (s, _), n in counts.items() if s == 0) == 40_000 and sum(n for (s, _), n in counts.items() if s == 1) == 4_000
    for s, n in ((0, 40_000), (1, 4_000)):
        chi = sum((counts[s, j] - n / 8) ** 2 / (n / 8) for j in range(8))
        assert 0.3 < chi < 29  # 7 degrees of freedom: beyond either end about once in 10,000


def test_slots_are_numbered_once_and_each_block_drawn_at_most_twice(spark):
    mix = mixing.Mix(odd(spark), block=4, shard_blocks=16)
    drawn = mixing.slots(mix.sources, 4, 16).collect()
    plan = {r._no: r for r in mix.sources.collect()}
    for no, r in plan.items():
        mine = [x for x in drawn if x._no == no]
        assert sorted(x._slot for x in mine) == list(range(r._draws))
        times = Counter(x._index for x in mine)
        assert all(n <= 2 for n in times.values()) and all(0 <= i < r._blocks for i in times)
        assert max(times.values(), default=0) - min((times[i] for i in range(r._blocks)), default=0) <= 1


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 10, 97):
        df = spark.range(n).withColumn("keys", mixing._round_keys(F.lit("s:x"), F.lit(n).cast("long"), 5)[0])
        there = mixing.permuted(F.col("id"), F.col("keys"), F.lit(n).cast("long"))
        back = mixing.permuted(F.col("there"), F.reverse("keys"), F.lit(n).cast("long"))
        rows = df.withColumn("there", there).withColumn("back", back).collect()
        assert sorted(r.there for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_empty_table_and_no_words(spark, tmp_path):
    none = cases.written(spark, tmp_path / "none", documents=cases.empty_documents(spark))
    assert mixing.op12_mixing(spark, none).count() == 0
    blank = cases.written(spark, tmp_path / "blank", documents=cases.documents(spark, [None, "", " \n"]))
    assert got(mixing.op12_mixing(spark, blank)) == [(i, 0, 0, 0.0, 0) for i in (1, 2, 3)]


def test_water_level_with_many_sources(spark):
    rng = random.Random(9)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 7)) for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "_source string, _source_size long").repartition(5)
    got_targets = {r._source: r._target for r in mixing.targets(df).collect()}
    assert got_targets == {s: float(t) for s, t in slow_targets(sizes).items()}


def test_native_plan(spark):
    plan = mixing.op12_mixing(spark, SF0001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
