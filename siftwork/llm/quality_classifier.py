"""Quality classifier: a sparse ensemble of rules over text statistics.

Short boosted trees over a bounded sample of labelled documents propose conjunctions of
thresholds; a lasso logistic fit keeps few of them; the result is a Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.names import col, free, without
from siftwork.llm.text_stats import with_counts

PREFIX = "_stat_"
#: Ratios of two counts; each is 0 where the lower one is 0.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_lines", "n_words"),
    "upper": ("n_upper", "n_chars"),
    "digits": ("n_digits", "n_chars"),
    "marks": ("n_marks", "n_words"),
    "shouts": ("n_shouts", "n_words"),
    "same_words": ("n_same_words", "n_words"),
    "distinct": ("n_distinct_words", "n_words"),
    "long_words": ("n_long_words", "n_words"),
}
FEATURES = (*RATIOS, "n_words")


@dataclass
class RuleModel:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[str, bool, float], ...]] = field(default_factory=list)  # (feature, above, threshold)
    weights: list[float] = field(default_factory=list)

    def score(self, prefix: str = PREFIX) -> Column:
        """The score as an expression over the count columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = None
            for name, above, at in rule:
                test = feature(name, prefix) > F.lit(at) if above else feature(name, prefix) <= F.lit(at)
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def feature(name: str, prefix: str = PREFIX) -> Column:
    if name not in RATIOS:
        return F.col(prefix + name).cast("double")
    up, low = (F.col(prefix + c) for c in RATIOS[name])
    return F.when(low > 0, up / low).otherwise(F.lit(0.0))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _best_split(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, features: np.ndarray, least: int):
    best, total = None, residual[rows].sum()
    for f in features:
        if not len(cuts[f]):
            continue
        side = np.searchsorted(cuts[f], x[rows, f], "left")  # x <= cuts[k] for side <= k
        n = np.cumsum(np.bincount(side, minlength=len(cuts[f]) + 1))[:-1]
        s = np.cumsum(np.bincount(side, residual[rows], minlength=len(cuts[f]) + 1))[:-1]
        m = len(rows) - n
        ok = (n >= least) & (m >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1), -np.inf)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0]:
                best = (gain[k], f, float(cuts[f][k]))
    return best if best and best[0] > total**2 / len(rows) + 1e-9 else None


def _propose(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int, depth: int, seed: int) -> list[tuple]:
    """Root-to-node paths of boosted trees, each tree over a random half of the features."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 99))) for f in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        features = np.sort(rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False))
        level = [((), np.arange(len(y)))]
        for d in range(depth):
            grown = []
            for path, rows in level:
                found = _best_split(x, cuts, residual, rows, features, max(5, len(y) // 500))
                if not found:
                    margin[rows] += 0.5 * 4 * residual[rows].mean()
                    continue
                _, f, at = found
                for above in (False, True):
                    into = rows[(x[rows, f] > at) == above]
                    step = (*path, (names[f], above, at))
                    rules[step] = None
                    grown.append((step, into))
            level = grown
        for _, rows in level:
            margin[rows] += 0.5 * 4 * residual[rows].mean()
    return list(rules)


def _holds(rule: tuple, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in rule:
        out &= (x[:, names.index(name)] > at) == above
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic fit with an absolute-value penalty, by accelerated proximal gradient steps."""
    center, scale = r.mean(0), np.maximum(r.std(0), 0.02)
    z = (r - center) / scale
    rate = 4 / max(1e-9, np.linalg.eigvalsh(z.T @ z / len(z))[-1] + 1)
    weight, bias = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    ahead, ahead_bias, t = weight, bias, 1.0
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(z @ ahead + ahead_bias))) - y
        new = ahead - rate * (z.T @ gap) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = ahead_bias - rate * gap.mean()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / following * (new - weight)
        ahead_bias = new_bias + (t - 1) / following * (new_bias - bias)
        weight, bias, t = new, new_bias, following
    return bias - float((weight * center / scale).sum()), weight / scale


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """A rule model for features `x` and labels `y` (0/1); without both labels it knows only their share."""
    if not len(y):
        return RuleModel()
    if y.min() == y.max():
        return RuleModel(bias=2.0 if y[0] else -2.0)
    rules = _propose(x, y, names, trees, depth, seed)
    r = np.stack([_holds(rule, x, names) for rule in rules], 1).astype(float)
    _, kept = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows count once
    kept = np.sort(kept)
    bias, weights = _lasso(r[:, kept], y, penalty, 300)
    some = np.flatnonzero(weights)
    return RuleModel(bias, [rules[kept[k]] for k in some], [float(weights[k]) for k in some])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label: str = "quality") -> RuleModel:
    """A model from at most `sample_rows` labelled documents that are not held out.

    The sample is the rows with the smallest hash of doc_id, so it is the same in every run. Rows
    without doc_id or label are left out; a document labelled twice takes its larger label.
    """
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows
    counted = with_counts(rows, "text", prefix=PREFIX, keep=["doc_id", "_label"])
    ordered = counted.select("doc_id", "_label", *[feature(f).alias(f) for f in FEATURES]).orderBy(F.xxhash64("doc_id"), *["doc_id", *FEATURES])
    data = ordered.limit(sample_rows).toPandas()
    return fit(data[list(FEATURES)].to_numpy(float), data["_label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs`, and `score`: 0 to 1, higher where label 1 is likelier.

    Null and empty texts have all statistics 0 and get a score like any other. A column of `keep`
    named `score`, in any case, gives way to the model's; other names may be any.
    """
    keep = without(docs.columns if keep is None else keep, ["score"])
    prefix = free(PREFIX, docs.columns)
    return with_counts(docs, "text", prefix=prefix, keep=keep).select(*map(col, keep), model.score(prefix).alias("score"))


def accepted(docs: DataFrame, model: RuleModel, least: float) -> DataFrame:
    """The rows of `docs` whose score is at least `least`, with their own columns, whatever their names."""
    prefix = free(PREFIX, docs.columns)
    return with_counts(docs, "text", prefix=prefix).filter(model.score(prefix) >= least).select(*map(col, docs.columns))
