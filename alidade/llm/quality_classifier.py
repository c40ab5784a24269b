"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

Small trees are grown in numpy on the statistics of a bounded labelled sample. Every path from a root to a
node is a rule: a conjunction of bounds. A logistic model with a lasso penalty weighs the rules; those with
weight 0 go. The rest becomes one Spark expression over the statistics, which are Spark expressions too.

Defined results: a null or empty text has statistics 0 and a score like any other; texts are read
whole; repeated rows and ids are scored row by row; an empty table gives an empty one; other columns are ignored.
Without a labelled row the score is 0.5, and with labels of one kind only nearly 0 or 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (statistic, is it an upper bound, bound)
Bound = tuple[str, bool, float]


def _count(text: Column, others: str) -> Column:
    """Number of characters that are left when runs of `others` are removed."""
    return F.length(F.regexp_replace(text, others, ""))


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules bound: shares, means and logarithms, none of them of the id, source or language."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)
    some = F.greatest(n_words, F.lit(1)).cast("double")
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "symbol_share": _count(text, "[^#*$%&|<>]+") / chars,
        "upper_share": _count(text, "[^A-Z]+") / chars,
        "digit_share": _count(text, "[^0-9]+") / chars,
        "mark_share": _count(text, "[^!?]+") / chars,
        "word_chars": (F.length(text) - _count(text, "[^ \\t-\\r]+")) / some,
        "distinct_words": F.size(F.array_distinct(words)) / some,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines.cast("double"),
        "words_a_line": n_words / n_lines.cast("double"),
    }


@dataclass
class RuleEnsemble:
    """Rules with their weights; score = logistic(bias + the weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[Bound, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """Over columns named as the statistics."""
        terms = [F.when(reduce(lambda a, b: a & b, map(_holds, bounds)), F.lit(w)).otherwise(F.lit(0.0)) for bounds, w in self.rules]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(bound: Bound) -> Column:
    name, upper, limit = bound
    return F.col(name) <= limit if upper else F.col(name) > limit


def matches(bounds: tuple[Bound, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, upper, limit in bounds:
        values = x[:, names.index(name)]
        out &= values <= limit if upper else values > limit
    return out


def tree_paths(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, bins: int = 24, seed: int = 7) -> list[tuple[Bound, ...]]:
    """The distinct paths of trees that are grown on resampled rows, with a few statistics to choose from at each node."""
    rng = np.random.default_rng(seed)
    grid = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    balance = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    found: dict[tuple[Bound, ...], None] = {}

    def grow(rows: np.ndarray, path: tuple[Bound, ...]) -> None:
        if path:
            found.setdefault(_tidy(path))
        w, pos = balance[rows], balance[rows] * y[rows]
        if len(path) == depth or len(rows) < 10 or pos.sum() <= 0 or pos.sum() >= w.sum() * (1 - 1e-12):
            return
        best = (1e-9, None)
        for k in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1])) + 1), replace=False):
            if not len(grid[k]):
                continue
            place = np.searchsorted(grid[k], x[rows, k], "left")  # value <= grid[j] where place <= j
            left_w = np.cumsum(np.bincount(place, w, len(grid[k]) + 1))[:-1]
            left_pos = np.cumsum(np.bincount(place, pos, len(grid[k]) + 1))[:-1]
            right_w, right_pos = w.sum() - left_w, pos.sum() - left_pos
            with np.errstate(divide="ignore", invalid="ignore"):
                impure = np.nan_to_num(left_pos * (1 - left_pos / left_w)) + np.nan_to_num(right_pos * (1 - right_pos / right_w))
            impure[(left_w <= 0) | (right_w <= 1e-15)] = np.inf
            j = int(np.argmin(impure))
            gain = pos.sum() * (1 - pos.sum() / w.sum()) - impure[j]
            if gain > best[0]:
                best = (gain, (k, float(grid[k][j])))
        if best[1] is not None:
            k, limit = best[1]
            low = x[rows, k] <= limit
            if low.any() and not low.all():
                grow(rows[low], (*path, (names[k], True, limit)))
                grow(rows[~low], (*path, (names[k], False, limit)))

    for _ in range(trees):
        grow(np.unique(rng.integers(0, len(y), len(y))), ())
    return list(found)


def _tidy(path: tuple[Bound, ...]) -> tuple[Bound, ...]:
    """One bound a statistic and side, the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, upper, limit in path:
        at = (name, upper)
        tight[at] = limit if at not in tight else min(tight[at], limit) if upper else max(tight[at], limit)
    return tuple(sorted((name, upper, limit) for (name, upper), limit in tight.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 2e-3, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias is free, the weights have the lasso penalty."""
    n, m = r.shape
    design = np.column_stack([np.ones(n), r])
    rate = 4.0 * n / (np.linalg.norm(design, 2) ** 2 + 1e-12)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    now = np.zeros(m + 1)
    now[0] = math.log(share / (1 - share))
    ahead, t = now.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - rate * (design.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - now)
        now, t = new, t_new
    return float(now[0]), now[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble()
    if y.min() == y.max():
        return RuleEnsemble(bias=6.0 if y[0] else -6.0)
    paths = tree_paths(x, y, names)
    held = np.column_stack([matches(p, x, names) for p in paths]).astype(float)
    _, first = np.unique(held, axis=1, return_index=True)  # paths that hold for the same rows count once
    first = np.sort(first)
    bias, weights = lasso_logistic(held[:, first], y.astype(float))
    return RuleEnsemble(bias, [(paths[k], float(w)) for k, w in zip(first, weights, strict=True) if abs(w) > 1e-6])


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 6000) -> RuleEnsemble:
    """Fit on at most most_docs labelled rows, by the order of a hash of the id; rows with crc32(id) mod 5 = 0 are held out."""
    code = F.crc32(F.col(id_col).cast("string"))
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (code % 5 != 0))
    chosen = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    stats = statistics(F.col("text"))
    rows = texts.select("label", *(c.alias(k) for k, c in stats.items())).collect()
    x = np.array([[r[k] for k in stats] for r in rows], float).reshape(len(rows), len(stats))
    y = np.array([r.label for r in rows], int)
    order = np.lexsort((y, *x.T[::-1]))  # sums do not depend on the order in which rows arrive
    return fit_rules(x[order], y[order], list(stats))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Return the columns of docs, score (0 to 1) and predicted (1 if score >= least, else 0); a column of docs with such a name gives way.

    One pass of column expressions without Python or shuffle.
    """
    rest = docs.drop("score", "predicted")
    stats = statistics(F.col(text_col))
    packed = rest.select(F.struct(*rest.columns).alias("row"), *(c.alias(k) for k, c in stats.items()))
    scored = packed.select("row", model.score().alias("score"))
    return scored.select("row.*", "score", (F.col("score") >= least).cast("int").alias("predicted"))
