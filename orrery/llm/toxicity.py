"""Toxicity severity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w.x)`` with one weight vector for all
thresholds ``theta_1 < theta_2 < ...``; weights and thresholds are those of greatest
(penalised) likelihood of the grades. The features are sparse: each distinct
whitespace-separated token of a document gives its word and its first four and
five letters. Labels are binary, so the grades of toxic documents are the thirds
of their share of tokens that carry a marker (a feature the labels tie strongly
to toxicity); grade 0 is not toxic: only this grade is known from the labels, the
others order the toxic ones by the model's own features. The result is the expected
grade. A document is toxic if P(grade > 0) reaches a cut, the best by F1 over labelled
rows that are left out of the fit, a fold at a time.

The model is fitted on a documented, bounded sample of labelled rows (the
``MAX_LABELLED`` smallest hashes of the id, copies thinned out); every document is
scored, whole.

Defined results: a null or empty text has no feature and scores the base rate;
without labels, or with one class only, every severity is 0 and nothing is toxic;
null labels are not used; a document id labelled twice counts by its larger label;
repeated rows give repeated results; columns beyond those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ship_code, slices_by_chars, staged, unique_key, worker_cache

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 20_000
#: Documents a feature must occur in to enter.
MIN_DOCS = 3
#: Chi-square that a feature must reach: below it, chance would bring in many.
MIN_CHI = 25.0
#: Odds ratio from which a feature marks a token as toxic.
MARKER_ODDS = 8.0
GRADES = 3
#: Words that a worker keeps, and characters of text that it holds at once.
CACHE_WORDS, SLICE_CHARS = 150_000, 3_000_000
#: Folds of the labelled rows by which the cut is chosen.
FOLDS = 3
#: Penalties: an absolute one that chooses features, a small square one for the final weights.
L1 = 2e-3
RIDGE = 1e-3

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def token_features(token: str) -> list[str]:
    """The word of a lower-case token and its first letters."""
    core = _NOT_LETTERS.sub("", token)
    if not core:
        return []
    found = ["w" + core]
    if len(core) > 4:
        found.append("4" + core[:4])
    if len(core) > 5:
        found.append("5" + core[:5])
    return found


@dataclass
class Ordinal:
    """A fitted model: feature weights and ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    theta: np.ndarray = field(default_factory=lambda: np.full(GRADES, 50.0))
    #: P(grade > 0) from which a document counts as toxic.
    cut: float = 0.5
    fitted: bool = False

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return _sigmoid(eta[:, None] - self.theta[None, :])


class Scores(dict):
    """Token to summed weight, filled as tokens are met."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        score = self[token] = sum(self.weights.get(f, 0.0) for f in token_features(token))
        return score


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def loss_and_slopes(eta: np.ndarray, theta: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the weighted log-likelihood of the grades, and its slopes by ``eta`` and by ``theta``.

    ``P(grade = k) = sigmoid(theta_k - eta) - sigmoid(theta_(k-1) - eta)``, where the
    thresholds of grade 0 and of the highest grade are open at one side.
    """
    n, k = len(eta), len(theta)
    at = np.arange(n)
    below, upto = np.zeros((n, k + 2)), np.zeros((n, k + 2))  # sigmoid and its slope at -inf, each threshold, inf
    below[:, 1:-1] = _sigmoid(theta[None, :] - eta[:, None])
    below[:, -1] = 1.0
    upto[:, 1:-1] = below[:, 1:-1] * (1 - below[:, 1:-1])
    high, low = below[at, grade + 1], below[at, grade]
    p = np.maximum(high - low, 1e-300)
    slope_theta = np.zeros(k + 2)
    np.add.at(slope_theta, grade + 1, -weight * upto[at, grade + 1] / p)
    np.add.at(slope_theta, grade, weight * upto[at, grade] / p)
    return float(-(weight * np.log(p)).sum()), weight * (1 - high - low), slope_theta[1:-1]


def _minimise(x, grade, weight, n_features, l1, ridge, steps, start=None):
    """Accelerated proximal gradient with backtracking; thresholds are the first one and the logs of the gaps."""
    rows, cols, vals = x
    n = len(grade)

    def thresholds(z):
        return z[0] + np.concatenate([[0.0], np.cumsum(np.exp(z[1:]))])

    def smooth(w, z):
        theta = thresholds(z)
        eta = np.bincount(rows, vals * w[cols], n)
        value, by_eta, by_theta = loss_and_slopes(eta, theta, grade, weight)
        by_z = np.cumsum(by_theta[::-1])[::-1]  # a gap moves all thresholds behind it
        by_z = np.concatenate([by_z[:1], by_z[1:] * np.exp(z[1:])]) + 1e-3 * z
        return value + 0.5 * ridge * float(w @ w) + 0.5e-3 * float(z @ z), np.bincount(cols, vals * by_eta[rows], n_features) + ridge * w, by_z

    w = np.zeros(n_features) if start is None else start[0].copy()
    z = np.zeros(GRADES) if start is None else np.concatenate([start[1][:1], np.log(np.diff(start[1]))])
    y_w, y_z, t, rate = w, z, 1.0, 1.0
    best = smooth(w, z)[0] + l1 * np.abs(w).sum()
    still = 0
    for _ in range(steps):
        value, g_w, g_z = smooth(y_w, y_z)
        while True:
            new_w = y_w - rate * g_w
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
            new_z = np.clip(y_z - rate * g_z, -30, 30)
            d_w, d_z = new_w - y_w, new_z - y_z
            reached = smooth(new_w, new_z)[0]
            if reached <= value + g_w @ d_w + g_z @ d_z + (d_w @ d_w + d_z @ d_z) / (2 * rate) + 1e-12 or rate < 1e-9:
                break
            rate *= 0.5
        now = reached + l1 * np.abs(new_w).sum()
        if now > best and t > 1:  # the momentum led uphill: start it anew
            y_w, y_z, t = w, z, 1.0
            continue
        still = still + 1 if best - now < 1e-7 * abs(best) else 0
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y_w, y_z = new_w + (t - 1) / t_next * (new_w - w), new_z + (t - 1) / t_next * (new_z - z)
        w, z, t, best, rate = new_w, new_z, t_next, min(best, now), rate * 1.1
        if still >= 5:
            break
    return w, thresholds(z)


def fit(x: list[dict[int, int]], grade: np.ndarray, n_features: int, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest likelihood, classes in balance.

    An L1 pass chooses the features; a ridge pass over the chosen ones takes the
    shrinkage back.
    """
    rows = np.repeat(np.arange(len(x)), [len(d) for d in x])
    cols = np.fromiter((c for d in x for c in d), np.int64)
    vals = np.fromiter((v for d in x for v in d.values()), float)
    toxic = grade > 0
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    w, theta = _minimise((rows, cols, vals), grade, weight, n_features, L1 + 2.0 / n1, 0.0, steps)
    kept = w != 0
    use = kept[cols]
    new = np.cumsum(kept) - 1
    part, theta = _minimise((rows[use], new[cols[use]], vals[use]), grade, weight, int(kept.sum()), 0.0, RIDGE, steps, (w[kept], theta))
    out = np.zeros(n_features)
    out[kept] = part
    return out, theta


def left_out(x: list[dict[int, int]], grade: np.ndarray, n_features: int) -> np.ndarray:
    """P(grade > 0) of each row, by a model of the other ``FOLDS - 1`` folds."""
    p = np.zeros(len(x))
    fold = np.empty(len(x), np.int64)
    for toxic in (False, True):  # each fold has its share of both
        own = np.flatnonzero((grade > 0) == toxic)
        fold[own] = np.arange(len(own)) % FOLDS
    for k in range(FOLDS):
        rest, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        weights, theta = fit([x[i] for i in rest.tolist()], grade[rest], n_features)
        eta = np.array([sum(weights[c] * v for c, v in x[i].items()) for i in held.tolist()])
        p[held] = _sigmoid(eta - theta[0])
    return p


def one_of_copies(sample: DataFrame) -> DataFrame:
    """One document of each class and smallest hash of three words, under two hashes.

    Near copies mostly share it; without this, what a copied document says by
    chance would look like a mark of its class.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    for seed in (1, 2):
        smallest = F.when(
            F.size("words") > 2,
            F.array_min(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda i: F.xxhash64(F.lit(seed), F.get("words", i - 2), F.get("words", i - 1), F.get("words", i)))),
        ).otherwise(F.xxhash64("text"))
        sample = sample.withColumn("words", words).withColumn("least", smallest).groupBy("y", "least").agg(F.min("text").alias("text")).select("y", "text")
    return sample


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Ordinal:
    """Fits the model on the labelled documents."""
    spark = docs.sparkSession
    ship_code(spark)
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .dropna()
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MAX_LABELLED)
    )
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most MAX_LABELLED rows of two numbers: small enough to send whatever the input.
    sample = staged(one_of_copies(text.join(F.broadcast(chosen), "id").select("y", "text")), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("features", dict)  # what an earlier stage kept goes
        for batch in batches:
            seen = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y > 0].update({f for w in set((t or "").lower().split()) for f in token_features(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())],
                ["feature", "toxic", "clean"],
            )

    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Ordinal()
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    total = float(n1 + n0)
    chi = total * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (F.greatest(a + b, F.lit(1.0)) * F.greatest(total - a - b, F.lit(1.0)) * n1 * n0)
    counts = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Features of at most MAX_LABELLED rows, far fewer than they have words.
    top = (
        counts.filter(F.col("toxic") + F.col("clean") >= MIN_DOCS)
        .withColumn("chi", chi)
        .filter(F.col("chi") >= MIN_CHI)
        .orderBy(F.desc("chi"), "feature")
        .collect()
    )
    names = {r["feature"]: i for i, r in enumerate(top)}
    markers = {r["feature"] for r in top if (r["toxic"] + 0.5) / (n1 + 1) > MARKER_ODDS * (r["clean"] + 0.5) / (n0 + 1) and r["toxic"] >= MIN_DOCS}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = Counter((t or "").lower().split())
                x, marked = Counter(), 0
                for w, n in tokens.items():
                    own = token_features(w)
                    x.update(names[f] for f in own if f in names)
                    marked += n * any(f in markers for f in own)
                for to, value in zip(out, (y, list(x), list(x.values()), marked / max(1, tokens.total())), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.float64())],
                ["y", "col", "val", "share"],
            )

    # At most MAX_LABELLED rows, each with the few features that were chosen.
    rows = sample.mapInArrow(project, "y int, col array<int>, val array<int>, share double").collect()
    y = np.array([r["y"] > 0 for r in rows])
    share = np.array([r["share"] for r in rows])
    if not names or not y.any():
        return Ordinal()
    cuts = np.quantile(share[y], np.arange(1, GRADES) / GRADES)
    grade = np.where(y, 1 + (share[:, None] > cuts[None, :]).sum(1), 0)
    x = [dict(zip(r["col"], r["val"], strict=True)) for r in rows]
    weights, theta = fit(x, grade, len(names))
    model = Ordinal({f: float(weights[i]) for f, i in names.items() if weights[i]}, theta, fitted=True)
    if min(int(y.sum()), int((~y).sum())) >= FOLDS:
        model.cut = best_cut(left_out(x, grade, len(names)), y)
    return model


def best_cut(p: np.ndarray, toxic: np.ndarray) -> float:
    """The probability from which the F1 of the labelled documents is best; halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(toxic[order])
    last = np.append(p[1:] < p[:-1], True)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum()), -1.0)
    at = int(f1.argmax())
    return float((p[at] + p[at + 1]) / 2) if at + 1 < len(p) else float(p[at])


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``id_col``, ``severity`` (expected grade), ``p_toxic``, ``grade`` (likeliest) and ``is_toxic``.

    The columns named in ``carry`` come along in the struct ``carried``.
    """
    ship_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = unique_key("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        cache = worker_cache(key, lambda: Scores(own.weights))
        for batch in batches:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            eta = []
            texts = batch.column(1).field(text_col) if carry else batch.column(1)
            for start, stop in slices_by_chars(texts, SLICE_CHARS):
                for text in texts.slice(start, stop - start).to_pylist():
                    eta.append(sum(map(cache.__getitem__, set(text.lower().split()))) if text else 0.0)
            exceed = own.exceed(np.array(eta, float))
            severity = exceed.sum(1)
            at_least = np.concatenate([np.ones((len(eta), 1)), exceed, np.zeros((len(eta), 1))], 1)
            grade = (at_least[:, :-1] - at_least[:, 1:]).argmax(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity), pa.array(exceed[:, 0]), pa.array(grade.astype(np.int32)), pa.array(exceed[:, 0] >= own.cut), *([batch.column(1)] if carry else [])],
                ["id", "severity", "p_toxic", "grade", "is_toxic", *more],
            )

    more = ["carried"] if carry else []
    # The text goes to Python once: as a column, or within what is carried.
    text = F.struct(*carry).alias("carried") if carry else F.col(text_col).cast("string").alias("text")
    source = docs.select(F.col(id_col).alias("id"), text)
    if not model.fitted:
        return source.select(
            F.col("id").alias(id_col), F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("is_toxic"), *more
        )
    kinds = dict(source.dtypes)
    schema = f"id {kinds['id']}, severity double, p_toxic double, grade int, is_toxic boolean" + (f", carried {kinds['carried']}" if carry else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def flag(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return score(docs, train(docs, labels), carry=carry)
