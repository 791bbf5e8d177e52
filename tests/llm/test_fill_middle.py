"""Fill-in-the-middle (operator 13) against brute force over code points."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from latentcf.llm import fill_middle as fm
from latentcf.llm.common import table
from tests.conftest import SF0001
from tests.llm import cases


def slow(doc_id, text):
    text = text or ""
    n, hexed = len(text), hashlib.sha256(b"1:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for i, t in rows:
        n, form, a, m, text = slow(i, t)
        out.append((i, n, form, a, m, sha(text), sha(t or "")))
    return sorted(out, key=repr)


def test_op13_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF0001, "documents").collect()]
    assert sorted(map(tuple, fm.op13_fill_middle(spark, SF0001).collect()), key=repr) == expected(docs)


def test_odd_rows_empty_table_and_clashing_columns(spark, tmp_path):
    texts = [*cases.ODD, "a<P>b", "x" * 500 + "<M>" + "y" * 500, "<", "<P", "P>", "é" * 40_000, "日" * 20_000 + "<S" + ">" * 3]
    ids = [*cases.ODD_IDS, *range(100, 107)]
    sf = cases.written(spark, tmp_path, documents=cases.documents(spark, texts, extra=True, ids=ids))
    assert sorted(map(tuple, fm.op13_fill_middle(spark, sf).collect()), key=repr) == expected(zip(ids, texts))
    done = fm.fill_in_middle(cases.documents(spark, texts, extra=True, ids=ids))
    assert {"row", "fp", "score"} <= set(done.schema["row"].dataType.names)
    none = cases.written(spark, tmp_path / "none", documents=cases.empty_documents(spark))
    assert fm.op13_fill_middle(spark, none).count() == 0


def test_restored_from_output_and_form(spark):
    texts = [f"{'<' * (i % 4)}{'SPM'[i % 3]} text {i} <{'é' * i}" for i in range(300)]
    done = fm.fill_in_middle(cases.documents(spark, texts))
    back = done.select("row.doc_id", fm.restored(F.col("fim_text"), F.col("form")).alias("t"), "form").collect()
    assert {r.doc_id: r.t for r in back} == dict(enumerate(texts, 1))
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_chunks_follow_content_not_place():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh äöü日本") for _ in range(60_000)).encode()
    cache = fm.Cache()
    one, two = fm.Chunked(b"start " + shared, cache), fm.Chunked(b"quite another start, longer " * 3 + shared, cache)
    assert cache.hits > 0.9 * len(one.ends)
    assert one.points == len((b"start " + shared).decode()) and two.points - one.points == 28 * 3 - 6
    for c in (one, two):
        sizes = [b - a for a, b in zip([0, *c.ends], c.ends)]
        assert sum(sizes) == len(c.text) and max(sizes) <= fm.MOST and min(sizes[:-1]) >= fm.LEAST


def test_segments_do_not_move_the_ends(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghé日") for _ in range(50_000)).encode()
    whole = fm.ends(text)
    monkeypatch.setattr(fm, "SEGMENT", 1000)
    assert fm.ends(text) == whole


@pytest.mark.parametrize("text", ["", "a", "é", "日本" * 9000, "<P", "ab<M>", "x" * 40_000])
def test_every_code_point_is_located(text, monkeypatch):
    c = fm.Chunked(text.encode(), fm.Cache())
    points = sorted({0, len(text), *random.Random(5).sample(range(len(text) + 1), min(200, len(text) + 1))})
    assert c.points == len(text) and [c.byte_of(i) for i in points] == [len(text[:i].encode()) for i in points]


def test_cache_verifies_content_and_keeps_its_bound():
    cache = fm.Cache(bound=1000, fingerprint=lambda chunk: 7)  # every chunk collides
    assert cache(b"abc").points == 3 and cache("日本".encode()).points == 2 and cache(b"abc").points == 3
    assert cache.hits == 0
    cache = fm.Cache(bound=1000)
    for i in range(100):
        cache(b"%d" % i * 50)
        assert cache.held <= 1000 and cache.held == sum(len(c) for c, _ in cache.known.values())


def test_marks_across_summaries():
    for text in (b"<P>", b"a<M>b", b"<S", b"<<P>>"):
        for i in range(1, len(text)):
            for j in range(i, len(text) + 1):
                parts = [fm.summary(p) for p in (text[:i], text[i:j], text[j:]) if p]
                whole = parts[0]
                for p in parts[1:]:
                    whole = fm.joined(whole, p)
                assert whole == fm.summary(text)
