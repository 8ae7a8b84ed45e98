"""Quality scores by a sparse ensemble of rules.

Small regression trees, each grown on what the ones before leave, split on statistics of texts. Every path of a tree
from its root is a rule, a conjunction of bounds on statistics. A lasso fit of logistic weights keeps few of them; the
penalty is the one under which a part of the learned rows that the fit doesn't see is likeliest. The rules kept become one Column expression over the statistics, which
are columns themselves, so all documents are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words

SAMPLE = 20_000  # labelled rows that are learned from at most, the first by a hash of text and label
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)  # of the lasso, strongest first
THRESHOLD = 0.3  # score from which the prediction is 1
FOLDS = 5  # rows of one of as many remainders are held out


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, all 0 where it has no words."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    n, chars = F.col("n_"), F.greatest(F.length(t), F.lit(1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    letters, upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", "")), count(r"\p{Lu}")
    return {
        "words": F.log1p(n.cast("double")),
        "word_length": share(F.length(F.regexp_replace(t, SPACE, "")), n),
        "distinct_words": share(F.size(F.array_distinct(F.col("w_"))), n),
        "symbols": share(F.length(t) - F.length(F.translate(t, "#*$%&|<>{}[]=~^_@+", "")), chars),
        "marks": share(F.length(t) - F.length(F.translate(t, ".,;:!?", "")), n),
        "mark_runs": share(count(r"[!?#*$%&=~^_]{2,}"), n),
        "links": share(count(r"[|›»•·→▸]|->|>>"), n),
        "digits": share(F.length(t) - F.length(F.translate(t, "0123456789", "")), chars),
        "letters": share(letters, chars),
        "upper": share(upper, letters),
        "line_words": share(n, F.size("l_")),
        "repeated_lines": share(F.size("l_") - F.size(F.array_distinct(F.col("l_"))), F.size("l_")),
        "unended_lines": share(F.size(F.filter("l_", lambda x: ~F.rlike(x, F.lit(r"[.!?:;…。][\"'”’»)\]]*[\x20\x09-\x0D]*$")))), F.size("l_")),
    } | {"_w": words(text), "_l": lines}


def with_statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """keep and the statistics, each a column, of docs (text)."""
    made = statistics(F.col("text"))
    w, lines = made.pop("_w"), made.pop("_l")
    base = docs.select(*keep, "text", w.alias("w_"), lines.alias("l_")).withColumn("n_", F.size("w_"))
    names = [c for c in base.columns if c not in ("text", "w_", "l_", "n_")]
    return base.select(*names, *(x.alias(f"s_{name}") for name, x in made.items()))


class Rule(NamedTuple):
    """A conjunction: for each of some features its lower (exclusive) and upper (inclusive) bound."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, high in self.bounds:
            out &= (x[:, f] > low) & (x[:, f] <= high)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, low, high in self.bounds:
            c = F.col(f"`{names[f]}`")
            out = out & (c > F.lit(low) if np.isfinite(low) else F.lit(True)) & (c <= F.lit(high) if np.isfinite(high) else F.lit(True))
        return out


def narrowed(rule: Rule, feature: int, low: float, high: float) -> Rule:
    held = {f: (a, b) for f, a, b in rule.bounds}
    a, b = held.get(feature, (-np.inf, np.inf))
    held[feature] = (max(a, low), min(b, high))
    return Rule(tuple((f, *ab) for f, ab in sorted(held.items())))


def best_split(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], least: int) -> tuple[int, float] | None:
    """Feature and bound that part rows so that the residual's squares shrink most; None if none does with least rows on either side."""
    best, found, total, n = 1e-9, None, residual.sum(), len(residual)
    for f, bounds in enumerate(cuts):
        cell = np.searchsorted(bounds, x[:, f], side="left")
        k, s = np.cumsum(np.bincount(cell, minlength=len(bounds) + 1))[:-1], np.cumsum(np.bincount(cell, residual, len(bounds) + 1))[:-1]
        good = (k >= least) & (n - k >= least)
        gain = np.where(good, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, 0.0)
        if len(gain) and gain.max() > best:
            best, found = float(gain.max()), (f, float(bounds[gain.argmax()]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 13) -> list[Rule]:
    """The paths of boosted trees, each once, in the order of growing. Each tree sees a seeded half of the rows."""
    rng, least = np.random.default_rng(seed), max(2, len(x) // 200)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin, rules = np.zeros(len(x)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        some = np.flatnonzero(rng.random(len(x)) < 0.5)
        level = [(Rule(()), some)]
        leaves = []
        for _ in range(depth):
            below = []
            for rule, rows in level:
                split = best_split(x[rows], (y - p)[rows], cuts, least) if len(rows) >= 2 * least else None
                if split is None:
                    leaves.append((rule, rows))
                    continue
                f, bound = split
                left = x[rows, f] <= bound
                for own, low, high in ((rows[left], -np.inf, bound), (rows[~left], bound, np.inf)):
                    child = narrowed(rule, f, low, high)
                    rules[child] = None
                    below.append((child, own))
            level = below
        for rule, rows in leaves + level:
            step = (y - p)[rows].sum() / max(1e-6, (p * (1 - p))[rows].sum())
            margin[rule.holds(x)] += RATE * np.clip(step, -4, 4)
    return list(rules)


def loss(a: np.ndarray, y: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """Mean negative log-likelihood."""
    z = a @ weights + intercept
    return float(np.mean(np.logaddexp(0, z) - y * z))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, weights: np.ndarray, intercept: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept of least mean loss plus penalty times the weights' sizes, by accelerated proximal gradient steps from given ones. The intercept isn't penalised."""
    both = np.append(weights, intercept)
    design = np.column_stack([a, np.ones(len(a), a.dtype)])
    v = np.ones(design.shape[1])
    for _ in range(20):  # the largest curvature
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(a) / float(np.linalg.norm(design @ v) ** 2 * 1.05)
    ahead, t = both.copy(), 1.0
    for _ in range(steps):
        z = design @ ahead
        new = ahead - rate * (design.T @ (1 / (1 + np.exp(-z)) - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, both, t = new + (t - 1) / after * (new - both), new, after
    return both[:-1], float(both[-1])


class Ensemble(NamedTuple):
    """Rules with weights; a text's score is the logistic function of the intercept and the weights of the rules that hold."""

    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The ensemble over columns of the statistics' names."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(self.names), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, seen: np.ndarray | None = None) -> Ensemble:
    """Rules of x (a row a text, a column a statistic) for labels y. seen tells the rows that weights are fitted to; the others choose the penalty. Without rows of both labels all score alike."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Ensemble(names, [], [], float(np.log(prior / (1 - prior))))
    seen = np.arange(len(y)) % 4 > 0 if seen is None else seen
    if len(np.unique(y[seen])) < 2 or seen.all():
        seen = np.ones(len(y), bool)
    rules = tree_rules(x[seen], y[seen])
    a = np.column_stack([r.holds(x) for r in rules]).astype(np.float64) if rules else np.zeros((len(x), 0))
    check = ~seen if (~seen).any() else seen
    weights, intercept, best = np.zeros(len(rules)), float(np.log(prior / (1 - prior))), None
    for penalty in PENALTIES:
        weights, intercept = lasso(a[seen], y[seen], penalty, weights, intercept)
        value = loss(a[check], y[check], weights, intercept)
        if best is None or value < best[0] - 1e-6:
            best = (value, weights, intercept)
    _, weights, intercept = best
    kept = np.flatnonzero(weights)
    return Ensemble(names, [rules[i] for i in kept], weights[kept].tolist(), intercept)


def remainder(doc_id: Column, n: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> Ensemble:
    """An ensemble learned from documents (doc_id, text) that labels (doc_id and a label of 0 or 1) tell of.

    Rows whose crc32 of doc_id leaves no remainder by folds are not learned from. Of the others sample rows at most are,
    the first by a hash; the rest are not needed. Null labels, and null ids, tell nothing; repeated labels count each.
    """
    told = labels.where(F.col(label).isNotNull() & (remainder(F.col("doc_id"), folds) != 0)).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("y"))
    told = told.orderBy(F.xxhash64("id", "y"), "id").limit(sample)  # a bounded sample, small enough to be broadcast
    met = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(told), "id")
    stats = with_statistics(met, F.xxhash64("text", "y").alias("h"), F.col("y"))
    rows = stats.orderBy("h").limit(sample).toPandas()  # ids may repeat; sample rows of some numbers each
    names = [c for c in rows.columns if c.startswith("s_")]
    h = rows["h"].to_numpy(np.int64)
    return fit(names, rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64), (h >> 7) % 4 > 0)


def score(docs: DataFrame, made: Ensemble, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of documents (doc_id, text).

    held_out tells whether training passes a row over by its id; a null id is none. A null text counts as empty and has
    a score like any other. Every row gives one row, repeated ids too; other columns are not read. An empty table gives
    no rows.
    """
    stats = with_statistics(docs, F.col("doc_id"))
    held = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    out = stats.select("doc_id", held.alias("held_out"), made.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
