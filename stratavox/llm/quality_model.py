"""Quality classifier: a sparse rule ensemble compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, let, materialise, text_or_empty, words_of

#: Statistics of a text that rules may test; all are 0 for an empty text.
STATISTICS = (
    "n_words",
    "word_length",
    "distinct_words",
    "repeated_words",
    "stop_short",
    "symbols",
    "digits",
    "capitals",
    "bangs",
    "bars",
    "stops",
    "line_words",
    "duplicate_lines",
)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``STATISTICS`` of each whole text: counts, and shares of words, characters or lines."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("words", words_of(F.col("text")))
    n = F.greatest(F.size("words"), F.lit(1)).cast("double")
    chars = F.greatest(F.length("text"), F.lit(1)).cast("double")
    hits = lambda pattern: F.regexp_count("text", F.lit(pattern)) / chars
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    neighbours = F.aggregate(F.transform("words", lambda w, i: F.when(F.get("words", i - 1) == w, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return rows.select(
        "doc_id",
        F.size("words").cast("double").alias("n_words"),
        (F.length(F.array_join("words", "")) / n).alias("word_length"),
        (F.size(F.array_distinct("words")) / n).alias("distinct_words"),
        (neighbours / n).alias("repeated_words"),
        (F.size(F.filter("words", lambda w: F.length(w) <= 3)) / n).alias("stop_short"),
        hits(r"[#*$%&<>]").alias("symbols"),
        hits("[0-9]").alias("digits"),
        hits(r"\p{Lu}").alias("capitals"),
        hits("!").alias("bangs"),
        hits(r"\|").alias("bars"),
        hits("[.]").alias("stops"),
        let(lines, lambda x: n / F.greatest(F.size(x), F.lit(1))).alias("line_words"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1))).alias("duplicate_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (statistic, at most or above, threshold) with its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        holds = F.lit(True)
        for name, at_most, threshold in self.tests:
            holds = holds & ((F.col(name) <= threshold) if at_most else (F.col(name) > threshold))
        return F.when(holds, F.lit(float(self.weight))).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if a else '>'} {t:.4g}" for n, a, t in self.tests) + f": {self.weight:+.3f}"


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    bias: float

    def margin(self) -> Column:
        total = F.lit(float(self.bias))
        for r in self.rules:
            total = total + r.column()
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, least: int, path: tuple, out: list) -> None:
    """A regression tree on quantile thresholds; every node below the root is a rule."""
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 2 * least:
        return
    y = residual[rows]
    best = (1e-9, None)
    for j in columns:
        v = x[rows, j]
        for t in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
            left = v <= t
            a = int(left.sum())
            if least <= a <= len(rows) - least:
                sa, s = y[left].sum(), y.sum()
                gain = sa * sa / a + (s - sa) ** 2 / (len(rows) - a) - s * s / len(rows)
                if gain > best[0]:
                    best = (gain, (j, t, left))
    if best[1] is None:
        return
    j, t, left = best[1]
    _grow(x, residual, rows[left], columns, depth - 1, least, (*path, (j, True, float(t))), out)
    _grow(x, residual, rows[~left], columns, depth - 1, least, (*path, (j, False, float(t))), out)


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, at_most, t in path:
        ok &= (x[:, j] <= t) if at_most else (x[:, j] > t)
    return ok


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ensemble(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 0.002, steps: int = 600, seed: int = 5) -> RuleEnsemble:
    """Rules from boosted trees on half samples, then logistic weights with an l1 penalty.

    Rows of the rarer label weigh more, so that both labels weigh alike up to a factor of 3. The
    penalty is met by proximal gradient steps with momentum. Rules of weight 0 are dropped. With
    one label only, or no rows, the ensemble is the smoothed share of label 1.
    """
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return RuleEnsemble((), bias)
    rng = np.random.default_rng(seed)
    balance = min(3.0, max(y.mean(), 1 - y.mean()) / min(y.mean(), 1 - y.mean()))
    weight = np.where(y == (y.mean() < 0.5), balance, 1.0)
    weight = weight / weight.sum()
    margin, paths = np.full(len(y), bias), []
    for _ in range(trees):
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        columns = rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)]
        found: list = []
        _grow(x, y - _sigmoid(margin), rows, columns, int(rng.integers(1, depth + 1)), max(5, len(y) // 400), (), found)
        for path in found:
            ok = _holds(x, path)
            if ok.any():
                margin = margin + 0.3 * ok * (y[ok] - _sigmoid(margin[ok])).mean()
        paths += found
    paths = list(dict.fromkeys(paths))
    z = np.stack([_holds(x, p) for p in paths], 1).astype(np.float64) if paths else np.zeros((len(y), 0))
    w, b, v, vb, t = np.zeros(len(paths)), bias, np.zeros(len(paths)), bias, 1.0
    rate = 4.0 / (1 + (z**2 * weight[:, None]).sum())
    for _ in range(steps):
        g = weight * (_sigmoid(z @ v + vb) - y)
        w_new = v - rate * (z.T @ g)
        w_new = np.sign(w_new) * np.maximum(0.0, np.abs(w_new) - rate * lasso)
        b_new = vb - rate * g.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    rules = [Rule(tuple((STATISTICS[j], a, th) for j, a, th in p), float(k)) for p, k in zip(paths, w, strict=True) if abs(k) > 1e-6]
    return RuleEnsemble(tuple(rules), float(b))


def fit(stats: DataFrame, marks: DataFrame, max_rows: int = 20_000) -> RuleEnsemble:
    """Fit on about ``max_rows`` labelled rows at most, chosen by the hash of the id.

    ``stats`` as from ``statistics``; ``marks`` has doc_id and quality (0 or 1; null is no label). Of
    rows that repeat an id the one with the least statistics counts.
    """
    good = marks.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = hash_sample(good, "doc_id", max_rows, 3)
    # About max_rows rows of two numbers at most, and as many of statistics.
    rows = stats.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("quality", *STATISTICS)).alias("s"))
    rows = rows.select("doc_id", "s.*").toPandas().sort_values("doc_id")
    return fit_ensemble(rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float))


def classify(docs: DataFrame, marks: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: label 1 likelier), predicted.

    Learns from the labels in ``marks`` alone, whose rows the caller chooses; ids, languages and
    sources are never inputs. Texts are read once: their statistics are written down and both the
    fit and the score read those. Scoring is a sum of column expressions. Null texts count as empty
    ones and get the score of an empty text; repeated rows count each; an empty table gives no rows;
    extra columns are ignored.
    """
    stats = materialise(statistics(docs), "statistics")
    model = fit(stats, marks, max_rows)
    scored = stats.select("doc_id", model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
