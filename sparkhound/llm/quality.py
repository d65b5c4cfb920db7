"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns.

1. Statistics of whole texts are Spark column expressions; labels, language, source and ids are never among them.
2. Small trees are fitted on labelled rows; each path from a root is a rule, a conjunction of comparisons.
3. A logistic model with a lasso penalty weighs the rules; most get weight zero and are dropped.
4. The remaining rules become one column expression, so scoring is a projection: no shuffle, no Python.

Fitting uses at most ``FIT_ROWS`` labelled rows, the smallest by a hash of doc_id; scoring covers every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import packed, unpacked

FIT_ROWS = 12_000
TREES = 24
DEPTH = 3
LASSO = 0.002
THRESHOLD = 0.3
HELD_OUT_OF = 5

WORDS = r"[\x09-\x0D\x20]+"


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_words``, which lambdas can look into without splitting the text again."""
    return docs.withColumn("_words", F.filter(F.split(F.coalesce("text", F.lit("")), WORDS), lambda w: w != ""))


def statistics() -> dict[str, Column]:
    """Named statistics over text and _words; all are finite, also for null and empty texts."""
    t, words = F.coalesce("text", F.lit("")), F.col("_words")
    n, count = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    times = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return {
        "symbol_share": times("!$%&*#@|<>{}[]\\/=+~^_") / n,
        "digit_share": times("0123456789") / n,
        "upper_share": times("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "bars_a_word": times("|") / count,
        "bangs_a_word": times("!?") / count,
        "marks_a_word": times("#$%&*") / count,
        "stops_a_word": times(".") / count,
        "repeated_neighbours": F.size(F.filter(words, lambda w, k: w == F.get(F.col("_words"), k + 1))) / count,
        # log distinct over log all: unlike their ratio it hardly falls as texts grow
        "richness": F.when(F.size(words) > 0, F.log1p(F.size(F.array_distinct(words))) / F.log1p(F.size(words))).otherwise(1.0),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut) comparisons, all of which hold


@dataclass
class RuleModel:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1, as a column over statistics columns."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, cut in rule:
                x = F.col(prefix + self.names[k])
                holds = holds & ((x > cut) if above else (x <= cut))
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[k]} {'>' if up else '<='} {c:.4g}" for k, up, c in r) for r, w in self.rules]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= x[:, k] > cut if above else x[:, k] <= cut
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, cuts: list[np.ndarray], least: int, rules: list, out: np.ndarray) -> None:
    """Grow a regression tree on gradients; append each node's path and write leaf values to ``out``."""
    best = None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth:
        for k, cut in enumerate(cuts):
            if not len(cut):
                continue
            bin_ = np.searchsorted(cut, x[rows, k], side="left")  # bin b: cut[b-1] < x <= cut[b]
            n = np.cumsum(np.bincount(bin_, minlength=len(cut) + 1))[:-1]
            gs = np.cumsum(np.bincount(bin_, g[rows], len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(bin_, h[rows], len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            j = int(gain.argmax())
            if gain[j] > 1e-6 and (best is None or gain[j] > best[0]):
                best = (gain[j], k, cut[j])
    if best is None:
        out[rows] = -total_g / (total_h + 1)
        return
    _, k, c = best
    for above in (False, True):
        part = rows[(x[rows, k] > c) == above]
        rules.append((*path, (k, above, float(c))))
        _tree(x, g, h, part, rules[-1], depth - 1, cuts, least, rules, out)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Boosted trees for the rules, then lasso logistic weights by proximal gradient steps. One class: its smoothed share."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if n < 4 or y.min() == y.max():
        return RuleModel(names, base, [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    f, rules = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(n) < 0.7)
        use = [c if rng.random() < 0.7 else c[:0] for c in cuts]
        if not len(rows):
            continue
        step = np.zeros(n)
        _tree(x, p - y, np.maximum(p * (1 - p), 1e-6), rows, (), depth, use, max(2, len(rows) // 200), rules, step)
        f += 0.3 * step
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    z = np.stack([_holds(x, r) for r in rules], 1).astype(np.float64) if rules else np.zeros((n, 0))
    support = z.mean(0)
    use = (support > 0.002) & (support < 0.998)
    z, rules = z[:, use], [r for r, u in zip(rules, use, strict=True) if u]
    if not rules:
        return RuleModel(names, base, [])
    # columns are centred, so the intercept stays apart from the penalty; scale: standard deviation
    mean, scale = z.mean(0), np.maximum(z.std(0), 1e-9)
    a = (z - mean) / scale
    top = np.linalg.norm(a, 2) ** 2 / (4 * n)
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), base, 1.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a @ v + b)))
        b -= (p - y).mean() * 4
        new = v - a.T @ (p - y) / n / top
        new = np.sign(new) * np.maximum(np.abs(new) - lasso / top, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    weight = w / scale
    kept = [(r, float(c)) for r, c in zip(rules, weight, strict=True) if abs(c) > 1e-6]
    return RuleModel(names, float(b - (weight * mean).sum()), kept)


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text, mod 5, is 0. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleModel:
    """A model of labels.quality from at most ``rows`` labelled documents outside the held-out part.

    Rows with a null label are left out; labels without a document have no effect; labels other than 0 count as 1.
    """
    stats = statistics()
    chosen = labels.select("doc_id", (F.col("quality") != 0).cast("int").alias("_y")).where("_y is not null and doc_id is not null").where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)
    # at most ``rows`` pairs of numbers
    got = with_words(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("doc_id", "_y", *[c.cast("double").alias(k) for k, c in stats.items()]).collect()
    data = np.array(sorted(tuple(r) for r in got), np.float64).reshape(-1, len(stats) + 2)
    return fit_rules(data[:, 2:], data[:, 1], list(stats))


def scored(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``_score`` (0 to 1) and ``_predicted`` (0 or 1)."""
    stats = {f"_stat_{k}": c.cast("double") for k, c in statistics().items()}
    score = with_words(docs).withColumns(stats).withColumn("_score", model.score("_stat_"))
    return score.withColumn("_predicted", F.when(F.col("_score") >= threshold, 1).otherwise(0)).drop("_words", *stats)


def quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null texts count as empty and are scored like any other. Repeated rows are scored each. Without usable labels the score
    is 0.5 everywhere. An empty table gives an empty result.
    """
    model = fit(docs, labels, rows)
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model predicts as label 1; all columns come through unchanged."""
    # A row number, which always holds, keeps the filter above the statistics: pushed below them it would compute each
    # statistic anew for every comparison of every rule.
    decided = scored(packed(docs, ["text"]), model, threshold).withColumn("_keep", F.when(F.monotonically_increasing_id() >= 0, F.col("_predicted")))
    return unpacked(decided.where("_keep = 1"), docs.columns, ["text"])
