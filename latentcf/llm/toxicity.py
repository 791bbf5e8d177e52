"""Toxicity by a weighted lexicon (operator 7).

Texts are folded (case, accents, look-alike letters of other scripts, digits
used as letters), then one Aho-Corasick automaton finds the lexicon's words
and stems and the exception phrases in a single pass. Weights of the matches
outside exception phrases are summed and normalised by length; a logistic
curve over these two figures gives the score.

The unit of the lexicon is the whole word. A word is kept if it stands in
``LEAST_TEXTS`` toxic texts of the sample and is sure enough there; a stem only
if ``STEM_WORDS`` different words of it lean to toxic texts and no word of it
leans to clean ones. The weight of either is the log of its share of toxic texts
over its share of all other texts of the corpus, labelled or not, so what is
common outside the sample weighs nothing and is left out. Exception phrases (a lexicon word with
the word before or after it) are learned from clean texts; further ones can be
given.

Lexicon, phrases and curve are fitted on labelled rows, at most ``MAX_LABELLED``
of them (the first by a hash of doc_id): the words of these texts bound what the
driver holds. Labels are used only where crc32(doc_id as text) mod 5 is not 0;
the score itself sees the text alone.

Defined cases: a null or empty text scores like any text without matches; a
doc_id labelled more than once counts as toxic if any of its labels is; with
no usable labels (or only one class) the lexicon is empty and every score is
the smoothed share of toxic labels; repeated rows are scored once each.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentcf.llm.common import release, settle, table, whole_text

FOLDS = 5
MAX_LABELLED = 20_000
#: A word is kept if it stands in this many toxic texts of the sample, whatever its size, and the
#: lower bound of its toxic share is over the least one.
LEAST_TEXTS, LEAST_SHARE_WORD = 5, 0.5
#: A stem of so many letters is kept if so many different words of it lean to toxic texts, and the
#: lower bound of their common share is over the least one (it stands for unseen words as well).
STEM, STEM_WORDS, LEAST_SHARE_STEM = (5, 9), 4, 0.6
#: Texts in which a word must stand to lean either way.
LEAN_TEXTS = 3
#: A term must be this much likelier in toxic texts than in all others of the corpus.
LEAST_RATIO = 2.0
#: Clean texts (and no toxic one) in which an exception phrase must stand.
PHRASE_TEXTS = 3

# Letters of other scripts and digits that are drawn like a Latin letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i",
    "l": "i",
}


class _Fold(dict):
    """Code point -> folded text, found once per code point; what is no letter becomes a blank."""

    def __missing__(self, point):
        kept = (c for c in unicodedata.normalize("NFKD", chr(point)).lower() if not unicodedata.combining(c))
        flat = (d for c in kept for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        out = "".join(LOOK_ALIKE.get(c, c if c.isalpha() else " ") for c in flat)
        # marks and characters without width vanish instead of cutting a word
        if not out and unicodedata.category(chr(point)) not in ("Mn", "Me", "Cf"):
            out = " "
        elif unicodedata.category(chr(point)) == "Cf":
            out = ""
        self[point] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at both ends."""
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matcher(self):
        return _Matcher(self)

    def probability(self, weight: float, per_length: float) -> float:
        a, b, c = self.curve
        z = a + b * weight + c * per_length
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.machine.add_word(term, (len(term), weight, term))
        for phrase in lexicon.exceptions:
            folded = fold(phrase)
            if folded.strip() and folded not in lexicon.weights:
                self.machine.add_word(folded, (len(folded), None, folded))
        if len(self.machine):
            self.machine.make_automaton()

    def terms(self, folded: str) -> set[str]:
        """The words and stems that stand in a text."""
        return {found[2] for _, found in self.machine.iter(folded)} if len(self.machine) else set()

    def matches(self, folded: str) -> list[tuple[int, int, float, str]]:
        """(start, end, weight, term) of each matched word outside exception phrases; the
        heaviest term counts where several match at the same word."""
        if not len(self.machine):
            return []
        found, free = {}, []
        for end, (n, weight, term) in self.machine.iter(folded):
            start = end - n + 1
            if weight is None:
                free.append((start, end))
            elif start not in found or found[start][2] < weight:
                found[start] = (start, end, weight, term)
        if not free:
            return list(found.values())
        free.sort()
        out, at, until = [], 0, -1  # until: where the phrases that began so far end
        for start in sorted(found):
            while at < len(free) and free[at][0] <= start:
                until, at = max(until, free[at][1]), at + 1
            if start > until - 1:
                out.append(found[start])
        return out

    def figures(self, text: str) -> tuple[float, float, int]:
        """log of 1 + summed weight, the same per length, matches."""
        folded = fold(text)
        hits = self.matches(folded)
        total = sum(h[2] for h in hits)
        return math.log1p(total), math.log1p(100 * total / (1 + folded.count(" "))), len(hits)


def _training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic), each text once, of at most ``max_labelled`` labelled documents outside the held-out fold."""
    by_id = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(~held_out(F.col("doc_id")))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # at most max_labelled rows of two numbers
    picked = texts.join(F.broadcast(by_id), "doc_id").groupBy("text").agg((F.max("toxic") > 0).alias("toxic"))
    return settle(picked, "toxicity-sample")


def held_out(doc_id: Column) -> Column:
    """The held-out fold; a row without a doc_id is in it (no label can be its own)."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(FOLDS)) == 0, F.lit(True))


def _count_task(batches):
    import pyarrow as pa

    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            (toxic if label else clean).update(set(fold(text).split()))
    # counts of one task, bounded by the sample
    names = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()),
                                      pa.array([clean[t] for t in names], pa.int64())], names=["word", "toxic", "clean"])


def _lower_share(k: int, n: int, z: float = 1.64) -> float:
    """Lower bound of a share k of n (Wilson)."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _candidates(counts: DataFrame) -> dict[str, int]:
    """Words (" word ") and stems (" pref") that are sure enough in the sample, with their toxic texts (for
    a stem: the sum over its words)."""
    words = counts.where((F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") > F.col("clean"))).collect()
    out = {f" {r['word']} ": r["toxic"] for r in words if _lower_share(r["toxic"], r["toxic"] + r["clean"]) >= LEAST_SHARE_WORD}
    letters = F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word") - 1))
    cut = counts.where(F.length("word") > STEM[0]).select("toxic", "clean", F.explode(F.transform(
        letters, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"))
    leans = lambda a, b, times: F.count_if((F.col(a) >= LEAN_TEXTS) & (F.col(a) > times * F.col(b)))
    stems = cut.groupBy("stem").agg(leans("toxic", "clean", 2).alias("for"), leans("clean", "toxic", 1).alias("against"),
                                    F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    for r in stems.where((F.col("for") >= STEM_WORDS) & (F.col("against") == 0)).orderBy(F.length("stem"), "stem").collect():
        shorter = any(f" {r['stem'][:n]}" in out for n in range(STEM[0], len(r["stem"])))
        if not shorter and _lower_share(r["toxic"], r["toxic"] + r["clean"]) >= LEAST_SHARE_STEM:
            out[f" {r['stem']}"] = r["toxic"]
    return out


def _texts_with(rows: DataFrame, terms: list[str], where: str | None = None) -> dict[str, int]:
    """In how many texts each term stands, over all ``rows`` (column text); '' counts the texts."""
    lexicon = Lexicon(dict.fromkeys(terms, 1.0))

    def task(batches):
        import pyarrow as pa

        matcher, count = lexicon.matcher(), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                count[""] += 1
                count.update(matcher.terms(fold(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                         names=["term", "n"])

    picked = rows.where(where) if where else rows
    found = picked.select("text").mapInArrow(task, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in found.collect()}  # one row a term


def _weighted(terms: list[str], toxic: dict[str, int], every: dict[str, int]) -> dict[str, float]:
    """Log of a term's share of toxic texts over its share of all other texts of the corpus, labelled or
    not; those of too small a ratio are left out."""
    n_toxic, n = toxic.get("", 0), max(0, every.get("", 0) - toxic.get("", 0))
    out = {}
    for t in sorted(terms):
        held = toxic.get(t, 0)
        ratio = ((held + 0.5) / (n_toxic + 1)) / ((max(0, every.get(t, 0) - held) + 0.5) / (n + 1))
        if ratio >= LEAST_RATIO:
            out[t] = math.log(ratio)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon from labelled documents (see the module's text for what bounds it), weighed against all of ``docs``."""
    rows = _training_rows(docs, labels, max_labelled)
    sizes = rows.groupBy("toxic").count().collect()  # two rows
    n_toxic, n_clean = (sum(r["count"] for r in sizes if r["toxic"] == t) for t in (True, False))
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -2.0
    if not n_toxic or not n_clean:
        return Lexicon(exceptions=exceptions, curve=(min(prior, -1e-3), 0.0, 0.0))
    counts = settle(rows.mapInArrow(_count_task, "word string, toxic long, clean long")
                    .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-words")
    terms = sorted(_candidates(counts))
    release(counts)
    every = _texts_with(docs.select(whole_text().alias("text")), terms)
    lexicon = Lexicon(_weighted(terms, _texts_with(rows, terms, "toxic"), every), exceptions)
    lexicon.exceptions += _learned_exceptions(rows, lexicon)
    lexicon.curve = _curve(rows, lexicon)
    release(rows)
    return lexicon


def _learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Lexicon words with the word before or after them that stand in clean labelled texts only."""

    def task(batches):
        import pyarrow as pa

        matcher, count = lexicon.matcher(), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folded = fold(text)
                phrases = set()
                for start, _, _, _ in matcher.matches(folded):
                    end = folded.index(" ", start + 1)
                    word = folded[start + 1 : end]
                    if end + 1 < len(folded):
                        phrases.add(f"{word} {folded[end + 1 : folded.index(' ', end + 1)]}")
                    if start > 0:
                        phrases.add(f"{folded[folded.rindex(' ', 0, start) + 1 : start]} {word}")
                count.update((p, bool(label)) for p in phrases)
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()),
                                          pa.array([count[k] * k[1] for k in keys], pa.int64()),
                                          pa.array([count[k] * (not k[1]) for k in keys], pa.int64())],
                                         names=["phrase", "toxic", "clean"])

    kept = (rows.mapInArrow(task, "phrase string, toxic long, clean long").groupBy("phrase")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where((F.col("toxic") == 0) & (F.col("clean") >= PHRASE_TEXTS)).orderBy("phrase"))
    return tuple(r["phrase"] for r in kept.collect())


def _curve(rows: DataFrame, lexicon: Lexicon, steps: int = 30, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Logistic curve over the two figures of the sample (Newton steps, ridge on the slopes)."""
    import numpy as np

    def task(batches):
        import pyarrow as pa

        matcher = lexicon.matcher()
        for b in batches:
            x = [matcher.figures(t)[:2] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([round(v[0], 3) for v in x], pa.float64()),
                                              pa.array([round(v[1], 3) for v in x], pa.float64()),
                                              pa.array([int(v) for v in b.column(1).to_pylist()], pa.int64())],
                                             names=["a", "b", "y"])

    got = (rows.mapInArrow(task, "a double, b double, y long").groupBy("a", "b")
           .agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("a", "b").collect())  # <= MAX_LABELLED rows
    x = np.array([[1.0, r["a"], r["b"]] for r in got])
    y, n = np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)
    w = np.zeros(3)
    penalty = np.diag([1e-6, ridge, ridge]) * n.sum() ** 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (n * p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (n * p - y) + penalty @ w)
    return tuple(float(v) for v in w)


def score_udf(lexicon: Lexicon):
    """Text -> struct(score, matches, weight) as a pandas UDF; the lexicon (bounded) ships with it."""
    @F.pandas_udf("score double, matches long, weight double")
    def score(texts: pd.Series) -> pd.DataFrame:
        if not hasattr(lexicon, "_matcher"):
            lexicon._matcher = lexicon.matcher()
        found = [lexicon._matcher.figures(t) for t in texts]
        return pd.DataFrame({"score": [lexicon.probability(w, p) for w, p, _ in found],
                             "matches": [n for _, _, n in found], "weight": [w for w, _, _ in found]})

    return score


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, matches, weight per row of ``docs``."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_udf(lexicon)(whole_text()).alias("f"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("f.score").alias("score"),
                        (F.col("f.score") >= 0.5).cast("int").alias("predicted"),
                        F.col("f.matches").alias("matches"), F.col("f.weight").alias("weight"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return docs.where(score_udf(lexicon)(whole_text())["score"] < 0.5)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
