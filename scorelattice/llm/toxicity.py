"""Toxicity by a weighted lexicon (operator 6).

Texts are folded: lower case, letters that look alike (Cyrillic, Greek, full
width) to Latin, digits and signs that stand for letters to these, everything
else to a blank.  The lexicon is learnt from a bounded sample of labelled rows,
where texts that fold to the same count once: beginnings of words and whole words
that toxic texts hold much more often, each needed to explain some toxic texts.
All terms of the sample are candidates; a cover chooses from them in rounds of
Spark aggregates (every open text votes for the best term that it holds).  A second
term of a text must also occur in several contexts, so that words of one copied
passage stay out.  Weights are log odds.  Phrases around a term that clean texts
hold and toxic ones never do are exceptions: a term inside one does not count.

An Aho-Corasick automaton finds terms and exceptions in one pass over the whole
text.  The sum of weights, as it is and normalised by length, goes through a
logistic curve fitted on the same sample.

Inputs of a score come from the text alone.  Rows that are held out (crc32 of
the id modulo 3 is 1) are never learnt from.

Defined results: null text is the empty text, which scores low; null ids and
repeated rows are scored by their text; without labels of both kinds the lexicon
is empty and the score is the share of label 1 (0 if there are no labels); an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .common import labelled_sample, remainder, whole_text

#: Most labelled rows that are learnt from.
TRAINING_ROWS = 12_000
FOLDS, HELD_OUT = 3, 1
TOXIC = 0.7
#: Beginnings of words that may become terms, in characters.
SHORTEST, LONGEST = 3, 12
LEAST_ODDS = 3.0
#: Terms that a toxic text should find, and neighbouring words between which a term beyond the first must occur.
COVERS, CONTEXTS = 4, 8
#: Clean texts that make a phrase an exception.
EXCEPTION_TEXTS = 3

# Letters that look like Latin ones, and signs used in their place.
_LOOKALIKES = dict(
    zip("аеорсухіјѕһԛԝԁвкмнт", "aeopcyxijshqwdbkmht")
) | dict(zip("αεικνορτυχ", "aeikvoptux")) | {"ı": "i", "ɡ": "g"}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Folding(dict):
    """Code point to folded character, worked out when first met."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        if 0xFF01 <= point <= 0xFF5E:
            char = chr(point - 0xFEE0)
        char = char.lower()
        if len(char) != 1:
            char = char[0]
        out = _SIGNS.get(char) or _LOOKALIKES.get(char) or (char if char.isalpha() else " ")
        if char in "​‌‍⁠﻿­":
            out = ""
        self[point] = out
        return out


_FOLD = _Folding()


def folded(text: str) -> str:
    """Folded words, each with one blank before and after it."""
    return f" {' '.join(text.translate(_FOLD).split())} "


def word_features(word: str) -> list[str]:
    """Beginnings of a word (blank before) and the whole word (blanks around)."""
    return [f" {word[:n]}" for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


@dataclass(frozen=True)
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: Of the logistic curve: base, for the log of the sum, for the log of the sum per 100 words.
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            out.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        if len(out):
            out.make_automaton()
        return out


def hits(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """Matches (start, end, weight) in folded text, without those inside an exception."""
    if not len(automaton):
        return []
    found, except_ = [], []
    for last, (size, weight) in automaton.iter(text):
        (except_ if weight is None else found).append((last + 1 - size, last + 1, weight))
    if not except_:
        return found
    # Both by start: of the exceptions that begin no later, the one that ends last decides.
    found.sort()
    except_.sort(key=lambda e: e[:2])
    out, at, reach = [], 0, -1
    for f in found:
        while at < len(except_) and except_[at][0] <= f[0]:
            reach = max(reach, except_[at][1])
            at += 1
        if reach < f[1]:
            out.append(f)
    return out


def measures(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Sum of weights, each word's heaviest term once, and the number of words."""
    return folded_measures(folded(text), automaton)


def folded_measures(ready: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    at: dict[int, float] = {}
    for start, _, weight in hits(ready, automaton):
        at[start] = max(weight, at.get(start, 0.0))
    return sum(at.values()), max(ready.count(" ") - 1, 1)


def curve_inputs(total, words) -> np.ndarray:
    total, words = np.asarray(total, float), np.asarray(words, float)
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / words)])


def _foldings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded texts with a key, so that texts that fold to the same count once."""
    for batch in batches:
        texts = [folded(t) for t in batch.column(1).to_pylist()]
        keys = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(keys, pa.binary())], names=["id", "text", "label", "key"]
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each toxic text the features of its words, each with the words before and after it (as a hash)."""
    for batch in batches:
        for text, doc in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
            words = ["", *text.split(), ""]
            found = set()
            for before, word, after in set(zip(words, words[1:], words[2:])):
                context = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
                found.update((f, context) for f in word_features(word))
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * len(found), pa.int64()), pa.array([f for f, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())],
                names=["doc", "term", "context"],
            )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch that hold each feature."""
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(1).to_pylist():
            seen.update({f for word in set(text.split()) for f in word_features(word)})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])


def _phrases(terms: dict[str, float]):
    """Words next to a term's word, each folded text once: (phrase, label, n)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Lexicon(terms).automaton(), Counter()
        for batch in batches:
            for ready, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = set()
                for start, _, _ in hits(ready, automaton):
                    end = ready.index(" ", start + 1)
                    before = ready.rfind(" ", 0, start)
                    after = ready.find(" ", end + 1)
                    if before >= 0:
                        own.add((ready[before : end + 1], label))
                    if after >= 0:
                        own.add((ready[start : after + 1], label))
                seen.update(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
            names=["phrase", "label", "n"],
        )

    return find


def _measurer(lexicon: Lexicon):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [folded_measures(t, automaton) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([float(g[1]) for g in got], pa.float64()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "total", "words", "label"])

    return measure


def _nested(a: str, b: str) -> bool:
    """Whether one term is a beginning of the other."""
    return a.startswith(b.rstrip()) or b.startswith(a.rstrip())


def choose(held: DataFrame, terms: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Terms that cover the toxic texts, with log odds as weights.

    ``held`` has (term, doc), ``terms`` (term, n, contexts, weight).  In a round
    every text with too few terms votes for the best term that it holds: the one
    that most such texts hold, less what clean texts hold; the more contexts the
    better.  Terms with enough votes are chosen.  First every text wants one
    term, then ``COVERS``, of terms with ``CONTEXTS`` contexts.  What comes to the driver in a
    round are chosen terms and texts, no more than the sample has rows.
    """
    spark = held.sparkSession
    chosen: dict[str, float] = {}
    some = 3 if toxic >= 100 else 2
    needs = held.select("doc").distinct()
    for covers, contexts in ((1, 1), (COVERS, CONTEXTS)):
        open_terms = staged(held.join(terms.where(F.col("contexts") >= contexts), "term"))
        while True:
            names = spark.createDataFrame([(t,) for t in chosen], "chosen string")
            rest = open_terms
            if chosen:
                hit = held.join(F.broadcast(names), F.col("term") == F.col("chosen"), "left_semi")
                full = hit.groupBy("doc").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= covers).select("doc")
                rest = rest.join(F.broadcast(full), "doc", "left_anti")  # at most the rows of the sample
            gains = rest.groupBy("term").agg(
                F.count(F.lit(1)).alias("gain"), F.first("n").alias("n"), F.first("contexts").alias("contexts"), F.first("weight").alias("weight")
            )
            worth = F.struct(
                (F.col("gain") - 3.0 * F.col("n") * toxic / max(clean, 1)).alias("w"), "contexts", (~F.col("term").endswith(" ")).alias("open"),
                F.length("term").alias("size"), "term", "weight",
            )
            best = rest.select("term", "doc").join(gains.select("term", worth.alias("worth")), "term").groupBy("doc").agg(F.max("worth").alias("best"))
            voted = best.where("best.w > 0").groupBy("best.term", "best.weight").agg(F.count(F.lit(1)).alias("votes"), F.max("best").alias("best")).where(F.col("votes") >= some)
            picked = 0
            for row in sorted(voted.collect(), key=lambda r: (-r["votes"], r["term"])):
                if not any(_nested(row["term"], t) for t in chosen):
                    chosen[row["term"]] = row["weight"]
                    picked += 1
            # A term that begins or prolongs a chosen one says nothing new.
            open_terms = staged(_without_nested(open_terms, list(chosen))) if picked else open_terms
            if not picked:
                break
    return chosen


def _without_nested(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows whose term neither begins nor prolongs a chosen one."""
    bare = sorted({t.rstrip() for t in chosen})
    begins = {b[:k] for b in bare for k in range(1, len(b) + 1)}
    spark = rows.sparkSession
    own = F.rtrim("term")
    shorter = spark.createDataFrame([(x,) for x in sorted(begins)], "short string")
    longer = spark.createDataFrame([(x,) for x in bare], "long string")
    out = rows.join(F.broadcast(shorter), own == F.col("short"), "left_anti")
    ways = F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.rtrim(F.substring(F.col("term"), F.lit(1), k)))
    starts = out.select("term").distinct().select("term", F.explode(ways).alias("begin")).join(F.broadcast(longer), F.col("begin") == F.col("long"), "left_semi")
    return out.join(starts.select("term").distinct(), "term", "left_anti")


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit with a small ridge, by Newton's method; slopes are not negative."""
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-3, 1e-3]) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, grad)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Lexicon:
    """Learn from at most ``bound`` labelled rows that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", FOLDS) != HELD_OUT, bound)
    foldings = sample.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_foldings, "id long, text string, label int, key binary")
    sample = staged(foldings.groupBy("key", "label").agg(F.min("id").alias("id"), F.first("text").alias("text"))).select("id", "text", "label")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Lexicon(curve=(20.0 if toxic else -20.0, 0.0, 0.0))
    met = staged(sample.where("label = 1").mapInArrow(_contexts, "doc long, term string, context long"))
    common = met.groupBy("term").agg(F.count_distinct("doc").alias("p"), F.count_distinct("context").alias("contexts")).where("p >= 2")
    negative = sample.where("label = 0").mapInArrow(_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    known = common.join(negative, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("weight", odds)
    listed = staged(known.where(F.col("weight") >= LEAST_ODDS).select("term", "n", "contexts", "weight"))
    held = staged(met.join(listed, "term", "left_semi").select("term", "doc").distinct())
    terms = choose(held, listed, toxic, clean)
    around = sample.mapInArrow(_phrases(terms), "phrase string, label int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )
    harmless = around.where((F.col("clean") >= EXCEPTION_TEXTS) & (F.col("toxic") == 0))
    lexicon = Lexicon(terms, frozenset(r["phrase"] for r in harmless.collect()))
    seen = sample.mapInArrow(_measurer(lexicon), "id long, total double, words double, label int").toPandas().sort_values(["id", "total", "words"])
    curve = _curve(curve_inputs(seen["total"], seen["words"]), seen["label"].to_numpy(float))
    return Lexicon(lexicon.terms, lexicon.exceptions, curve)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, weight, n_words) of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in batches:
            got = [measures(t, automaton) for t in batch.column(1).to_pylist()]
            total, words = np.array([g[0] for g in got], float), np.array([g[1] for g in got], float)
            z = curve_inputs(total, words) @ curve if len(got) else total
            arrays = [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(total), pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "weight", "n_words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(score, "doc_id long, score double, weight double, n_words long")
