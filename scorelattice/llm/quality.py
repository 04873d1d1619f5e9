"""Quality by a sparse rule ensemble (operator 4).

Statistics of the text are Spark columns.  On a bounded sample of labelled rows
small trees are grown on them, one after another on what the earlier ones left
unexplained; every path from a root to a node is a rule, a conjunction of
comparisons.  A lasso logistic regression (numpy) weighs the rules and drops
most.  What is left is compiled into one Spark column, so scoring is a
projection: no join, no shuffle, no Python.

Inputs of a score are statistics of the text alone.  Rows that are held out
(crc32 of the id modulo 4 is 2) are never learnt from.

Defined results: null text is the empty text, which gets a score like any other;
null ids and repeated rows are scored by their text; without labels of both
kinds the score is the share of label 1 among those there are (1 if none); an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, labelled_sample, remainder, whole_text

#: Most labelled rows that are learnt from.
TRAINING_ROWS = 12_000
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
TREES, DEPTH, LEAST, CUTS = 16, 3, 8, 24
LASSO, ROUNDS, STEP_TREES = 2e-4, 1500, 0.5
#: Marks whose repetition is counted.
MARKS = ("!!", "%%%", "***", "&&&", "###", "$$$", " | ")

Condition = tuple[str, bool, float]


def statistics(text: str) -> dict[str, Column]:
    """Statistics of a text column that holds no nulls, as doubles."""
    t = F.col(text)
    size = F.char_length(t)
    per_char = F.greatest(size, F.lit(1))
    words = F.split(t, r"\s+", -1)
    n_words = F.greatest(F.size(words), F.lit(1))
    again = F.size(F.filter(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.size(words)).alias("b")), lambda p: p["a"] == p["b"]))
    out = {
        "chars": F.log1p(size.cast("double")),
        "word_length": size / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_words": again / n_words,
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / per_char,
        "marks": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")) / per_char,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / per_char,
        "wide": (F.octet_length(t) - size) / per_char,
        "lines": F.size(F.split(t, "\n", -1)) / n_words,
    }
    for i, mark in enumerate(MARKS):
        out[f"mark{i}"] = (size - F.char_length(F.replace(t, F.lit(mark), F.lit("")))) / (len(mark) * n_words)
    return {k: v.cast("double") for k, v in out.items()}


@dataclass(frozen=True)
class Rules:
    """score = logistic(base + sum of the weights of the rules that hold)."""

    base: float
    weights: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        total = F.lit(float(self.base))
        for weight, conditions in self.weights:
            holds = None
            for name, above, cut in conditions:
                one = columns[name] > F.lit(cut) if above else columns[name] <= F.lit(cut)
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list):
    """Least-squares tree on ``target``; appends every path and returns nested nodes."""
    value = float(target[rows].mean())
    if depth == 0 or len(rows) < 2 * LEAST:
        return value
    best = (1e-9, None)
    total, own = target[rows].sum(), target[rows]
    floor = total**2 / len(rows)
    for f in range(x.shape[1]):
        column = x[rows, f]
        for cut in cuts[f]:
            left = column <= cut
            n = int(left.sum())
            if n < LEAST or len(rows) - n < LEAST:
                continue
            s = own[left].sum()
            gain = s**2 / n + (total - s) ** 2 / (len(rows) - n) - floor
            if gain > best[0]:
                best = (gain, (f, float(cut)))
    if best[1] is None:
        return value
    f, cut = best[1]
    sides = []
    for above in (False, True):
        own_path = (*path, (f, above, cut))
        out.append(own_path)
        picked = rows[(x[rows, f] > cut) == above]
        sides.append(_grow(x, cuts, target, picked, depth - 1, own_path, out))
    return (f, cut, sides[0], sides[1])


def _predict(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, low, high = node
    return np.where(x[:, f] <= cut, _predict(low, x), _predict(high, x))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss with an l1 penalty; the base is free."""
    n, k = r.shape
    design = np.hstack([np.ones((n, 1)), r])
    step = 4.0 / max(np.linalg.eigvalsh(design.T @ design / n)[-1], 1e-9)
    w = z = np.zeros(k + 1)
    momentum = 1.0
    for _ in range(rounds):
        move = z - step * (design.T @ (_logistic(design @ z) - y) / n)
        move[1:] = np.sign(move[1:]) * np.maximum(np.abs(move[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z = move + (momentum - 1) / after * (move - w)
        w, momentum = move, after
    return float(w[0]), w[1:]


def learn(names: list[str], x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from statistics ``x`` and labels ``y`` in {0, 1}."""
    if not len(y) or y.min() == y.max():
        share = 1.0 if not len(y) else float(y.mean())
        return Rules(float(np.log((share + 1e-6) / (1 - share + 1e-6))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, CUTS))) for c in x.T]
    cuts = [np.unique(np.concatenate([c, [0.0]])) if (x[:, i] == 0).any() else c for i, c in enumerate(cuts)]
    log_odds, paths = np.zeros(len(y)), []
    for _ in range(TREES):
        tree = _grow(x, cuts, y - _logistic(log_odds), np.arange(len(y)), DEPTH, (), paths)
        log_odds = log_odds + 4 * STEP_TREES * _predict(tree, x)
    paths = sorted(set(paths))
    if not paths:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))), ())
    holds = np.column_stack(
        [np.all([(x[:, f] > cut) == above for f, above, cut in p], axis=0).astype(float) for p in paths]
    )
    _, kept = np.unique(holds, axis=1, return_index=True)
    base, weights = _lasso(holds[:, np.sort(kept)], y, LASSO, ROUNDS)
    chosen = [(float(w), tuple((names[f], above, cut) for f, above, cut in paths[i])) for w, i in zip(weights, np.sort(kept)) if abs(w) > 1e-3]
    return Rules(base, tuple(chosen))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Rules:
    """Learn from at most ``bound`` labelled rows that are not held out."""
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", FOLDS) != HELD_OUT, bound)
    columns = statistics("text")
    names = list(columns)
    rows = sample.select("id", "label", *[columns[n].alias(n) for n in names]).toPandas().sort_values(["id", *names])
    return learn(names, rows[names].to_numpy(float), rows["label"].to_numpy(float))


def scored(docs: DataFrame, rules: Rules, score: str = "score") -> DataFrame:
    """``docs`` with the score as a further column."""
    text, stats = fresh(docs, "_text"), fresh(docs, "_stats")
    named = docs.withColumn(text, whole_text())
    columns = statistics(text)
    # The statistics are computed once and then compared: they stay one struct.
    held = named.withColumn(stats, F.struct(*[c.alias(n) for n, c in columns.items()]))
    return held.withColumn(score, rules.column({n: F.col(f"{stats}.{n}") for n in columns})).drop(text, stats)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    score = fresh(docs, "_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) >= ACCEPT).select(*docs.columns)
