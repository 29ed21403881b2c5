"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of a text are plain column expressions.  Small regression trees,
boosted on a bounded sample of labelled rows, propose rules: every path from a
root to a node is a conjunction of comparisons.  A logistic model with an L1
penalty picks and weights few of them, and the result is compiled into one
column expression, so scoring is a projection without Python.

Defined results: null and empty texts have all statistics 0 and are scored
like any other; without labels of both classes the score is the base rate of
the sample (1 without any, so that nothing is rejected unseen); an id with both
labels counts as good; repeated rows are scored each; a score equal to the
threshold passes; an empty table gives no rows; very long texts are scored
whole; private columns get names that the table does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, one_row_each, sample_ids


@dataclass(frozen=True)
class RuleConfig:
    #: Labelled rows per class to learn from, at most.
    per_class: int = 5_000
    trees: int = 40
    depth: int = 3
    shrink: float = 0.3
    bins: int = 32
    least_leaf: int = 20
    penalty: float = 0.002
    rounds: int = 400
    threshold: float = 0.3


def statistics(text: Column, mark: str = "_q") -> dict[str, Column]:
    """Named statistics of a text, all doubles; white space is ASCII white space.  Words and lines are columns ``<mark>_words`` and ``<mark>_lines``."""
    w, l = f"{mark}_words", f"{mark}_lines"
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t).cast("double")

    def count(kept: str) -> Column:
        """Characters of ``kept`` (a plain set, no ranges)."""
        return chars - F.length(F.translate(t, kept, "")).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1.0))

    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x)) > 0)
    n_words, n_lines = F.size(w).cast("double"), F.size(l).cast("double")
    ascii_upper, ascii_lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return {
        w: words,
        l: lines,
        "n_words": n_words,
        "log_words": F.log1p(n_words),
        "word_chars": share(chars - count(" \t\n\r"), n_words),
        "distinct_words": share(F.size(F.array_distinct(w)).cast("double"), n_words),
        "n_lines": n_lines,
        "line_words": share(n_words, n_lines),
        "distinct_lines": share(F.size(F.array_distinct(l)).cast("double"), n_lines),
        "upper": share(count(ascii_upper), chars),
        "lower": share(count(ascii_lower), chars),
        "digits": share(count(digits), chars),
        "symbols": share(count("#*$%&|<>"), chars),
        "bars": share(count("|"), chars),
        "shouts": share(count("!?"), chars),
        "stops": share(count("."), chars),
        "commas": share(count(",;:"), chars),
        "brackets": share(count("()[]{}=_/\\"), chars),
        "spaces": share(count(" "), chars),
    }


def with_statistics(docs: DataFrame, text_column: str = "text") -> tuple[DataFrame, list[str], str]:
    """The rows with private columns ``<mark>_<statistic>``, the statistics' names, and the mark that no column of theirs begins with."""
    mark = "_q"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "q"
    made = statistics(F.col(text_column), mark)
    lists = {k: v for k, v in made.items() if k.startswith(mark)}
    rest = {f"{mark}_{k}": v for k, v in made.items() if k not in lists}
    return docs.withColumns(lists).withColumns(rest).drop(*lists), [k for k in made if k not in lists], mark


#: A rule: conditions (statistic, "<=" or ">", value), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleEnsemble:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float
    threshold: float = 0.3

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], config: RuleConfig = RuleConfig()) -> RuleEnsemble:
        """Learn from statistics [row, statistic] and labels 0/1."""
        if len(y) == 0 or y.min() == y.max():
            rate = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
            return cls(names, [], [], float(np.log(rate / (1 - rate))), config.threshold)
        rules = sorted(_grow_rules(x, y.astype(float), config))
        held = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
        varied = (held.mean(0) > 0.002) & (held.mean(0) < 0.998) if len(rules) else np.zeros(0, bool)
        _, first = np.unique(held, axis=1, return_index=True) if len(rules) else (None, np.zeros(0, int))
        use = sorted(set(first.tolist()) & set(np.flatnonzero(varied).tolist()))
        weights, intercept = _lasso(held[:, use], y.astype(float), config)
        keep = [k for k, w in enumerate(weights) if abs(w) > 1e-4]
        return cls(names, [rules[use[k]] for k in keep], [float(weights[k]) for k in keep], intercept, config.threshold)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * _holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def score(self, mark: str = "_q") -> Column:
        """The score as an expression over the private statistics columns."""
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            holds = None
            for k, above, value in rule:
                c = F.col(f"{mark}_{self.names[k]}")
                one = c > F.lit(value) if above else c <= F.lit(value)
                holds = one if holds is None else holds & one
            z = z + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, value in rule:
        out &= (x[:, k] > value) if above else (x[:, k] <= value)
    return out


def _grow_rules(x: np.ndarray, y: np.ndarray, config: RuleConfig) -> set[Rule]:
    """Paths of boosted regression trees on the logistic residual."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, config.bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    rules: set[Rule] = set()
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-z))
        grad, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        while nodes:
            path, rows = nodes.pop()
            split = _best_split(codes[rows], grad[rows], weight[rows], cuts, config) if len(path) < config.depth else None
            if split is None:
                z[rows] += config.shrink * np.clip(grad[rows].sum() / (weight[rows].sum() + 1.0), -4, 4)
                continue
            k, b = split
            low = codes[rows, k] <= b
            for above, part in ((False, rows[low]), (True, rows[~low])):
                rule = path + ((k, above, float(cuts[k][b])),)
                rules.add(rule)
                nodes.append((rule, part))
    return rules


def _best_split(codes, grad, weight, cuts, config: RuleConfig) -> tuple[int, int] | None:
    best, found = 1e-3, None
    g_all, w_all = grad.sum(), weight.sum()
    for k, cut in enumerate(cuts):
        m = len(cut) + 1
        if m < 2:
            continue
        n = np.cumsum(np.bincount(codes[:, k], minlength=m))[:-1]
        g = np.cumsum(np.bincount(codes[:, k], grad, m))[:-1]
        w = np.cumsum(np.bincount(codes[:, k], weight, m))[:-1]
        gain = g**2 / (w + 1) + (g_all - g) ** 2 / (w_all - w + 1) - g_all**2 / (w_all + 1)
        gain[(n < config.least_leaf) | (len(grad) - n < config.least_leaf)] = -1
        b = int(gain.argmax())
        if gain[b] > best:
            best, found = gain[b], (k, b)
    return found


def _lasso(a: np.ndarray, y: np.ndarray, config: RuleConfig) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    n, m = a.shape
    mean = a.mean(0)
    a = a - mean
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    if not m:
        return w, b
    v = np.ones(m)
    for _ in range(20):  # largest curvature, by the power method
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(a @ v) ** 2 / n + 1) + 1e-9)
    w2, b2, t = w.copy(), b, 1.0
    for _ in range(config.rounds):
        r = 1 / (1 + np.exp(-(a @ w2 + b2))) - y
        new = w2 - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * config.penalty, 0)
        new_b = b2 - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w2, b2 = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, float(b - mean @ w)


def learn_quality(docs: DataFrame, labels: DataFrame, config: RuleConfig = RuleConfig(), id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> RuleEnsemble:
    """Learn from a bounded sample of labelled rows that are not held out (crc32 of the id, mod 5, is 0)."""
    ids = sample_ids(labels.where(~held_out(id_column, 5, 0)), id_column, label_column, config.per_class)
    label_of = {i: int(y) for y, own in ids.items() for i in own}
    names = [k for k in statistics(F.col(text_column)) if not k.startswith("_q")]
    if not label_of:
        return RuleEnsemble.fit(np.zeros((0, len(names))), np.zeros(0), names, config)
    with_q, names, mark = with_statistics(one_row_each(docs, list(label_of), id_column, text_column, [text_column]), text_column)
    columns = [f"{mark}_{n}" for n in names]
    found = with_q.select(id_column, *columns).toPandas().sort_values([id_column, *columns])
    y = found[id_column].map(label_of).to_numpy()
    return RuleEnsemble.fit(found[columns].to_numpy(float), y, names, config)


def score_quality(docs: DataFrame, model: RuleEnsemble, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    rows, _, mark = with_statistics(docs.select(id_column, text_column), text_column)
    scored = rows.select(id_column, held_out(id_column, 5, 0).alias("held_out"), model.score(mark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_column: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with the columns they came with."""
    rows, _, mark = with_statistics(docs, text_column)
    # The row number in it keeps the filter above the projection: pushed below, it would work out every statistic once per rule.
    score = model.score(mark) + F.lit(0.0) * F.monotonically_increasing_id()
    scored = rows.select(*docs.columns, score.alias(f"{mark}_score"))
    return scored.where(F.col(f"{mark}_score") >= model.threshold).select(docs.columns)
