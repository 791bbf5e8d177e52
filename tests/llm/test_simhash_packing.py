"""Near-duplicates, multiset fingerprints, packing and training order against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from latentcf.llm import components, multiset, packing, simhash, tokens, training_order
from latentcf.llm.common import table
from latentcf.session import scratch_path
from tests.conftest import SF0001
from tests.llm import cases


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_pairs(fps):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 4]


def test_op3_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF0001, "documents").collect()}
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, SF0001).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    roots = slow_components(near_pairs(fps.values()), set(fps.values()))
    least = defaultdict(list)
    for i, f in fps.items():
        least[roots[f]].append(i)
    assert {i: r.component_id for i, r in got.items()} == {i: min(least[roots[f]]) for i, f in fps.items()}


@pytest.mark.parametrize("n,flips", [(3000, 3), (500, 2), (17, 1), (2000, 40)])
def test_gray_index_equals_all_pairs(n, flips):
    rng = np.random.default_rng(n)
    members = rng.integers(0, 1 << 63, 20, dtype=np.uint64)[rng.integers(0, 20, n)]
    for _ in range(flips):
        members ^= np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    members = np.unique(members)
    edges = [(int(a), int(b)) for a, b in simhash.GrayIndex(members).spanning(4)]
    pairs = [(int(members[i]), int(members[j])) for i in range(len(members))
             for j in i + 1 + np.flatnonzero(np.bitwise_count(members[i + 1 :] ^ members[i]) <= 4)]
    nodes = [int(m) for m in members]
    assert slow_components(edges, nodes) == slow_components(pairs, nodes)
    assert len(edges) < len(members)


def test_hot_pattern_is_dealt_into_cells(spark):
    rng = random.Random(3)
    base = 0x123456789ABCDEF0
    fps = {base}
    for _ in range(400):
        f = base
        for b in rng.sample(range(40), rng.randrange(1, 7)):
            f ^= 1 << b
        fps.add(f)
    members = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.link(members, cell=32).collect()]
    assert slow_components(edges, fps) == slow_components(near_pairs(fps), fps)
    assert len(edges) < 15 * 20 * len(fps)


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1300)] + [(1299, 2000), (2000, 4)]
    loops = [(7, 7), (8, 9), (9, 8), (8, 9)]
    got = {r.node: r.root for r in components.connected_components(
        spark.createDataFrame(chain + hub + loops, "a long, b long")).collect()}
    want = slow_components(chain + hub + loops, {n for e in chain + hub + loops for n in e})
    assert got == {n: r for n, r in want.items() if n != 7}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(spark):
    docs = cases.odd_documents(spark)
    got = simhash.components(docs).collect()
    assert len(got) == len(cases.ODD)
    by_fp = defaultdict(set)
    for r in got:
        by_fp[r.fp].add(r.component_id)
    assert all(len(v) == 1 for v in by_fp.values())
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3, 4)} == {1}  # no words: fingerprint zero
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 6").count() == 1
    assert simhash.components(cases.empty_documents(spark)).count() == 0
    assert simhash.keep_one(cases.empty_documents(spark)).count() == 0


def test_op2_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF0001, "documents").collect()}
    ids = sorted(docs)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    for r in multiset.op2_multiset(spark, SF0001).collect():
        t, u = docs[r.doc_id], docs[following[r.doc_id]]
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == multiset.Fingerprint(t).hex() and r.edited_fingerprint == multiset.Fingerprint(new).hex()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert r.near_next == pytest.approx(multiset.Fingerprint(t).likeness(multiset.Fingerprint(u)))


def test_multiset_fingerprint_is_homomorphic():
    a = multiset.Fingerprint("one two three\nfour five\nsix")
    assert a.hex() == multiset.Fingerprint("six\none two three\nfour five").hex()
    assert a.hex() != multiset.Fingerprint("one two three\nfour five\nsix\nsix").hex()
    assert multiset.Fingerprint("one two three\nfour five\nsix\nsix").remove("six").hex() == a.hex()
    assert multiset.Fingerprint.parse(a.hex()).hex() == a.hex() and a.likeness(a) == 1.0
    assert multiset.Fingerprint("").hex() == multiset.Fingerprint().add("").hex()


def test_op2_odd_rows(spark):
    docs = cases.odd_documents(spark)
    got = multiset.chain(docs, buckets=3).mapInArrow(multiset._pair_task, multiset.SCHEMA).collect()
    assert len(got) == len(cases.ODD)
    one = multiset.chain(cases.documents(spark, ["only one"])).mapInArrow(multiset._pair_task, multiset.SCHEMA).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert multiset.chain(cases.empty_documents(spark)).mapInArrow(multiset._pair_task, multiset.SCHEMA).count() == 0


def test_op2_with_a_doc_id_of_a_third_of_the_rows(spark):
    texts = [f"text number {i}\nand {i % 3}" for i in range(300)]
    ids = [7 if i % 3 == 0 else i for i in range(300)]
    docs = cases.documents(spark, texts, ids=ids)
    chained = multiset.chain(docs, buckets=12)
    assert chained.where("doc_id = 7").select("bucket").distinct().count() > 3
    order = sorted(zip(ids, (r.h for r in docs.select(F.xxhash64("text").alias("h")).collect()), texts))
    want = {t: multiset.edited(t, order[(k + 1) % 300][2]) for k, (_, _, t) in enumerate(order)}
    got = chained.mapInArrow(multiset._pair_task, multiset.SCHEMA).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want.values())


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_ids_equal_the_public_tokenizer():
    texts = ["", " ", "a  b ", "x\n y", "<|endoftext|>a", "don't we'll 12 34ab", "\x1c a", "日本 語 é 😀😀", "tab\there\r\n"]
    encode = tokens.Encoder(tokens.default_vocabulary())
    assert [encode(t) for t in texts] == reference_ids(texts)


def check_packing(rows, texts_by_id, ids_by_id):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, ids in ids_by_id.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        total = sum(p.length for p in pieces)
        assert 0 < total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    return padding / sum(map(len, ids_by_id.values()))


def test_op10_round_trip(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF0001, "documents").collect()}
    ids = {i: x + [1] for i, x in zip(docs, reference_ids(docs.values()))}
    assert check_packing(packing.op10_packing(spark, SF0001).collect(), docs, ids) < 0.01


def test_packing_odd_rows(spark):
    texts = [t for t in cases.ODD if t is None or len(t) < 60_000]
    rows = packing.pack(cases.documents(spark, texts, extra=True)).collect()
    ids = {i: x + [1] for i, x in enumerate(reference_ids(texts), 1)}
    assert check_packing(rows, texts, ids) < 0.01
    assert packing.pack(cases.empty_documents(spark)).count() == 0


def test_packer_classes_hold_fixed_counts():
    packer = packing.Packer(0)
    rng = random.Random(1)
    done = []
    for d in range(3000):
        done += list(packer.add(d, np.arange(rng.randrange(1, 6000), dtype="<u4")))
    sequences = defaultdict(list)
    for doc_id, _, length, *_, sequence, _ in done:
        sequences[sequence].append(length)
    for lengths in sequences.values():
        k = {2048 // n for n in lengths}
        assert len(k) == 1 and len(lengths) == k.pop()
    assert all(s & (s - 1) == 0 for s in map(sum, [[x] for x in packing.powers(2047)]))


def test_slot_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 70_000):
        order = training_order.SlotPermutation(n)
        slots = order.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (order.index(slots) == np.arange(n)).all()
    a, b = (training_order.SlotPermutation(1000, k).slot(np.arange(1000)) for k in ("a", "b"))
    assert (a != b).any()


def test_training_order_shards(spark):
    docs = table(spark, SF0001, "documents")
    folder = scratch_path(spark, "shards")
    index = sorted(training_order.materialise(docs, folder, length=256, per_shard=64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index)))
    assert all((r.shard, r.byte_offset) == (r.slot // 64, r.slot % 64 * 512) for r in index)
    got = dict(training_order.read_slots(folder, 0, 10**9, length=256, per_shard=64))
    assert [zlib.crc32(got[r.slot].tobytes()) for r in index] == [r.crc32 for r in index]
    stream = np.concatenate([got[r.slot] for r in sorted(index, key=lambda r: r.sequence_id)]).tolist()
    want = [i for ids in reference_ids([r.text for r in docs.collect()]) for i in ids + [tokens.END_OF_TEXT_ID]]
    assert stream[: len(want)] == want and set(stream[len(want) :]) <= {tokens.END_OF_TEXT_ID}
    later = dict(training_order.read_slots(folder, 70, 10, length=256, per_shard=64))
    assert list(later) == list(range(70, 80)) and (later[75] == got[75]).all()


def test_training_order_odd_rows(spark):
    folder = scratch_path(spark, "shards")
    assert training_order.materialise(cases.empty_documents(spark), folder).count() == 0
    got = training_order.materialise(cases.documents(spark, [None, "", "a b", "a b"], extra=True), folder, length=16)
    assert got.agg(F.countDistinct("slot")).first()[0] == got.count() > 0
