"""Quality classifier: a sparse ensemble of rules over text statistics.

Every text is described by statistics that Spark computes from the whole text. Small boosted trees are
grown on labelled texts; the path to each of their nodes is a rule, a conjunction of bounds on
statistics. A lasso logistic regression gives most rules the weight 0; its strength is the one that
predicts a fifth of the texts, set aside by hash, best. The rules left are compiled into one Spark column
expression, so that scoring is a projection without Python.

The trees and weights learn from at most ``TRAIN_TEXTS`` distinct texts, up to half of them of either
label and the first by a hash of the text; copies of a text are combined before they are moved and count
once, with the share of their labels as the target. Texts of a label that is rarer in the sample than in
the table weigh more. Everything else covers all rows.

Cases: null and empty texts have statistics of 0 and get the score that the rules give these; very long
texts are read whole; null labels, and labels other than 0 and 1, teach nothing; a document with two
labels teaches both; without a labelled text every score is 0.5, with one label only it is that label's
smoothed share; repeated rows each give a row; a null ``doc_id`` is not held out and has no label; an empty
table gives no rows; extra columns are ignored. Training is seeded, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.langid import held_out
from spanloom.session import materialize, table

TRAIN_TEXTS = 8000
TREES, DEPTH, CUTS, RATE, LEAST, SEED = 40, 3, 24, 0.3, 10, 5
STRENGTHS = 10
FIT_STEPS, SETTLED = 400, 1e-6
FEATURES = (
    "n_chars", "n_words", "word_length", "letter_share", "capital_share", "capital_runs_per_word", "digit_share", "mark_share", "stops_per_word",
    "exclamations_per_word", "words_per_sentence", "words_per_line", "ended_lines", "repeated_lines", "distinct_words_share", "echo_share", "longest_word",
)


def statistics(text: str = "text") -> dict[str, Column]:
    """Statistics of a whole text, by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars, words = F.char_length(t).cast("double"), count(r"\S+")
    letters, digits, spaces, stops = count(r"\p{L}"), count(r"\p{Nd}"), count(r"\s"), count(r"[.,;:!?]")
    lines = count(r"\n") + 1
    pieces, rows = F.split(F.lower(t), r"\s+"), F.split(t, r"\n")
    return {
        "chars": chars,
        "words": words,
        "letters": letters,
        "digits": digits,
        "spaces": spaces,
        "stops": stops,
        "lines": lines,
        "capitals": count(r"\p{Lu}"),
        "capital_runs": count(r"\p{Lu}{2,}"),
        "exclamations": count("!"),
        "sentences": count(r"[.!?](?!\S)"),
        "line_ends": count(r"(?m)[.!?:]$"),
        # a word that stands again right behind itself; words are entered at their first character only
        "echoes": count(r"(?<!\S)(\S++)(?=\s++\1(?!\S))"),
        "distinct_words": F.size(F.array_distinct(pieces)).cast("double"),
        "distinct_lines": F.size(F.array_distinct(rows)).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(pieces, F.char_length)), F.lit(0)).cast("double"),
    }


def shares() -> list[Column]:
    """``FEATURES``, which the rules look at, from the columns of :func:`statistics`."""
    c = F.col
    per = lambda a, b: a / F.greatest(b, F.lit(1.0))
    marks = c("chars") - c("letters") - c("digits") - c("spaces") - c("stops")
    found = [
        c("chars"),
        c("words"),
        per(c("chars") - c("spaces"), c("words")),
        per(c("letters"), c("chars")),
        per(c("capitals"), c("letters")),
        per(c("capital_runs"), c("words")),
        per(c("digits"), c("chars")),
        per(marks, c("chars")),
        per(c("stops"), c("words")),
        per(c("exclamations"), c("words")),
        per(c("words"), c("sentences")),
        per(c("words"), c("lines")),
        per(c("line_ends"), c("lines")),
        1 - per(c("distinct_lines"), c("lines")),
        per(c("distinct_words"), c("words")),
        per(c("echoes"), c("words")),
        c("longest"),
    ]
    return [column.alias(name) for column, name in zip(found, FEATURES, strict=True)]


def described(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Columns ``keep`` plus ``FEATURES`` of every row; the text itself goes."""
    held = docs.select(*[k.alias(f"_k{i}") for i, k in enumerate(keep)], *[v.alias(n) for n, v in statistics(text).items()])
    names = docs.select(*keep).columns
    return held.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(names)], *shares())


# ---- trees ----


@dataclass(frozen=True)
class Rule:
    """Bounds ``(feature, above, bound)`` that hold together: greater than the bound, or not."""

    bounds: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, bound in self.bounds:
            out &= x[:, f] > bound if above else x[:, f] <= bound
        return out

    def column(self) -> Column:
        parts = [F.col(FEATURES[f]) > bound if above else F.col(FEATURES[f]) <= bound for f, above, bound in self.bounds]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole & p
        return F.when(whole, F.lit(self.weight)).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {bound:.6g}" for f, above, bound in self.bounds) + f": {self.weight:+.3f}"


def _narrowed(bounds: tuple, new: tuple[int, bool, float]) -> tuple:
    """A path's bounds with one more; of two of a kind the narrower stays."""
    f, above, bound = new
    same = [b for b in bounds if b[:2] == new[:2]]
    if same:
        bound = max(bound, same[0][2]) if above else min(bound, same[0][2])
    return tuple(sorted([b for b in bounds if b[:2] != new[:2]] + [(f, above, bound)]))


def grow_rules(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The paths of boosted trees, in the order they were grown."""
    draw = np.random.default_rng(seed)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[:-1], method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)  # bin b: <= cuts[b]
    margin = np.zeros(n)
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        rows = np.flatnonzero(draw.random(n) < 0.6)
        features = draw.permutation(width)[: max(3, (2 * width) // 3)]
        todo = [((), rows, np.arange(n))]
        while todo:
            path, own, reach = todo.pop()
            split = _best_split(bins, g, h, own, features, cuts) if len(path) < DEPTH else None
            if split is None:
                margin[reach] += RATE * g[own].sum() / (h[own].sum() + 1.0)
                continue
            f, b = split
            for above in (False, True):
                inner = _narrowed(path, (int(f), above, float(cuts[f][b])))
                found.setdefault(inner)
                side = lambda r: r[(bins[r, f] > b) == above]  # noqa: B023, E731
                todo.append((inner, side(own), side(reach)))
    return [Rule(b) for b in found]


def _best_split(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """Feature and bin whose split of ``rows`` gains most."""
    if len(rows) < 2 * LEAST:
        return None
    best, gain = None, 1e-6
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    for f in features:
        k = len(cuts[f]) + 1
        gs, hs, ns = (np.bincount(bins[rows, f], weights=v, minlength=k).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
        if not len(gs):
            continue
        rest = g[rows].sum() - gs
        score = gs**2 / (hs + 1.0) + rest**2 / (h[rows].sum() - hs + 1.0) - whole
        score[(ns < LEAST) | (len(rows) - ns < LEAST)] = -np.inf
        at = int(score.argmax())
        if score[at] > gain:
            best, gain = (int(f), at), float(score[at])
    return best


# ---- lasso ----


def fit_lasso(r: np.ndarray, y: np.ndarray, w: np.ndarray, strength: float, start: np.ndarray) -> np.ndarray:
    """Logistic weights (the last one free: the intercept) with a penalty on absolute values, by accelerated proximal steps."""
    total = w.sum()
    bound = 0.25 * (np.einsum("ij,ij,i->", r, r, w, optimize=True) + total) / total  # of the curvature
    step = 1.0 / max(bound / 4, 1e-9)
    at, look, pace = start.copy(), start.copy(), 1.0
    cost = lambda v: _loss(r @ v[:-1] + v[-1], y, w) + strength * np.abs(v[:-1]).sum()
    last = cost(at)
    for _ in range(FIT_STEPS):
        miss = w * (1 / (1 + np.exp(-(r @ look[:-1] + look[-1]))) - y) / total
        slope = np.append(miss @ r, miss.sum())
        base = _loss(r @ look[:-1] + look[-1], y, w)
        while True:  # shorter steps until the loss lies under its parabola
            new = look - step * slope
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
            d = new - look
            if _loss(r @ new[:-1] + new[-1], y, w) <= base + slope @ d + (d @ d) / (2 * step) + 1e-12:
                break
            step /= 2
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = new + (pace - 1) / faster * (new - at)
        at, pace = new, faster
        now = cost(at)
        if abs(last - now) < SETTLED * max(1.0, abs(last)):
            break
        last = now
    return at


def _loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, margin) - y * margin)).sum() / w.sum())


@dataclass
class RuleModel:
    """Rules with weights, and the intercept."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The score as an expression over ``FEATURES``."""
        margin = F.lit(self.intercept)
        for r in self.rules:
            margin = margin + r.column()
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, aside: np.ndarray) -> RuleModel:
    """Rules of trees with lasso weights; the rows ``aside`` choose the strength."""
    prior = float((w @ y + 1) / (w.sum() + 2)) if len(y) else 0.5
    flat = RuleModel(float(np.log(prior / (1 - prior))))
    if len(y) < 4 * LEAST or min(y.min(), 1 - y.max()) > 0.5 or y.min() == y.max():
        return flat
    rules = grow_rules(x[~aside], y[~aside], w[~aside])
    if not rules:
        return flat
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(np.float64)
    _, first = np.unique(r, axis=1, return_index=True)  # of rules that hold for the same texts, the first grown
    keep = np.sort(first)
    r, rules = r[:, keep], [rules[i] for i in keep]
    inner = ~aside
    start = np.append(np.zeros(len(rules)), flat.intercept)
    miss = w[inner] * (prior - y[inner]) / w[inner].sum()
    most = float(np.abs(miss @ (r[inner] - r[inner].mean(axis=0))).max())
    best, lowest, strength = start, np.inf, most
    for strength in most * np.geomspace(0.5, 0.001, STRENGTHS):
        start = fit_lasso(r[inner], y[inner], w[inner], strength, start)
        off = _loss(r[aside] @ start[:-1] + start[-1], y[aside], w[aside]) if aside.any() else 0.0
        if off < lowest - 1e-4:
            best, lowest = start, off
    return RuleModel(float(best[-1]), [Rule(rule.bounds, float(b)) for rule, b in zip(rules, best[:-1], strict=True) if abs(b) > 1e-9])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", texts: int = TRAIN_TEXTS) -> RuleModel:
    """The model of ``label`` (0 or 1) from the labelled rows of ``docs``."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("_y")).distinct()
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_u")
    own = docs.where("doc_id is not null").select("doc_id", digest).join(known, "doc_id")  # texts stay where they are
    sums = materialize(own.groupBy("_u").agg(F.sum("_y").alias("ones"), F.count(F.lit(1)).alias("n")), "quality-labels")
    counts = sums.agg(F.count(F.when(F.col("ones") * 2 >= F.col("n"), 1)).alias("good"), F.count(F.when(F.col("ones") * 2 < F.col("n"), 1)).alias("poor")).first()
    each = texts // 2
    # a hash threshold takes about 1.2 times the texts wanted; the first by hash are kept
    near = lambda n: min(1.0, (1.2 * each + 50) / max(1, n))
    place = (F.col("_u") + float(1 << 63)) / float(1 << 64)
    good = F.col("ones") * 2 >= F.col("n")
    drawn = sums.where(place < F.when(good, F.lit(near(counts["good"]))).otherwise(F.lit(near(counts["poor"]))))
    # one text of every hash: statistics are computed for the sample only
    once = docs.select("text", digest).join(F.broadcast(drawn), "_u").groupBy("_u").agg(F.first("text").alias("text"), F.first("ones").alias("ones"), F.first("n").alias("n"))
    rows = sorted(described(once, [F.col("_u"), F.col("ones"), F.col("n")]).collect(), key=lambda r: r["_u"])  # at most about 1.2 * texts
    y = np.array([r["ones"] / r["n"] for r in rows])
    picked = np.sort(np.concatenate([np.flatnonzero(y >= 0.5)[:each], np.flatnonzero(y < 0.5)[:each]]).astype(np.int64))
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))[picked]
    y = y[picked]
    there = {True: max(1, int((y >= 0.5).sum())), False: max(1, int((y < 0.5).sum()))}
    weight = np.where(y >= 0.5, counts["good"] / there[True], counts["poor"] / there[False])
    aside = np.array([rows[i]["_u"] % 5 == 0 for i in picked], dtype=bool)
    return fit(x, y, weight / max(weight.mean(), 1e-12) if len(y) else weight, aside)


def predict(docs: DataFrame, model: RuleModel, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``score double`` of every row."""
    rows = described(docs, keep)
    return rows.select(*docs.select(*keep).columns, model.score().alias("score"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = predict(docs.select("doc_id", "text"), model, [F.col("doc_id"), held_out().alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
