"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by the non-negative unbiased risk
(Kiryo et al., 2017): R = pi R_p+ + max(0, R_u- - pi R_p-), with pi the estimated share of good texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import bounded_batches, forget, staged

#: Bounds of the training sample, the rows whose hashed ids are smallest: a documented parameter.
N_POSITIVE, N_UNLABELLED = 4000, 8000
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,;:", "!?", "|", "'\"()[]-", "*$#&%@^~<>={}\\/_+`"]
_N = len(_CLASSES) + 2  # letters outside ASCII, other bytes
_OF = np.full(256, _N - 1, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _OF[np.frombuffer(_chars.encode(), np.uint8)] = _i
_OF[128:] = _N - 2
#: Bytes are counted so many at a time.
_BLOCK = 1 << 20
WIDTH = _N + _N * _N + 5


def features(text: str | None) -> np.ndarray:
    """Shares of character classes and of their bigrams, and of repeated words, over the whole text; null as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    one, two, last = np.zeros(_N), np.zeros(_N * _N), None
    for at in range(0, len(raw), _BLOCK):
        c = _OF[raw[at : at + _BLOCK]]
        one += np.bincount(c, minlength=_N)
        if last is not None:
            two[last * _N + c[0]] += 1
        two += np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
        last = c[-1]
    words = text.split()
    n, m = max(len(raw), 1), max(len(words), 1)
    out = np.empty(WIDTH, np.float32)
    out[:_N] = one / n
    out[_N:-5] = np.sqrt(two / n)
    out[-5:] = (np.log1p(len(raw)) / 10, sum(map(str.__eq__, words, words[1:])) / m, len(set(words)) / m, min(len(raw) / m, 100) / 10, len(words) == 0)
    return out


@dataclass(frozen=True)
class Model:
    """Standardisation and weights of a network with one hidden layer; without training rows every score is 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def risk(z: np.ndarray, n_pos: int, prior: float) -> tuple[float, float]:
    """The two parts of the risk of logits ``z``, positives first, under the sigmoid loss: that of positives, and that of negatives before it is cut off at zero."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # l(+) = 1 - s, l(-) = s
    return prior * (1 - s[:n_pos]).mean(), s[n_pos:].mean() - prior * s[:n_pos].mean()


def risk_slope(z: np.ndarray, n_pos: int, prior: float) -> np.ndarray:
    """Slope of the non-negative risk; where the part of negatives is below zero, that of its negative alone: a step back along it."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    g = np.empty(len(z))
    if risk(z, n_pos, prior)[1] >= 0:
        g[:n_pos], g[n_pos:] = -2 * prior / n_pos, 1 / (len(z) - n_pos)
    else:
        g[:n_pos], g[n_pos:] = prior / n_pos, -1 / (len(z) - n_pos)
    return g * s * (1 - s)


def estimated_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.02, most: float = 0.98) -> float:
    """The share of positives among the unlabelled rows, from positives and unlabelled rows alone.

    One half of each trains a classifier of positives against unlabelled rows, and the other half is scored.
    Above any threshold stand a share of the positives and, of the unlabelled rows, at least the prior's
    part of that share; so their ratio bounds the prior from above, and it is close where only positives
    score so high. The threshold is the one of the least ratio with its sampling error.
    """
    if min(len(pos), len(unl)) < 20:
        return 0.5
    model = fit_nnpu(pos[::2], unl[::2], 0.5, epochs=20)
    p, u = np.sort(model.score(pos[1::2])), np.sort(model.score(unl[1::2]))
    at = np.quantile(p, np.linspace(0, 0.95, 96))  # at least a twentieth of the positives above
    share = lambda x: 1 - np.searchsorted(x, at) / len(x)
    error = (math.log(40) / 2) ** 0.5 * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((share(u) + error) / share(p))
    return float(np.clip(share(u)[best] / share(p)[best], least, most))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises the non-negative PU risk with the sigmoid loss by Adam; deterministic."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl]) if len(pos) + len(unl) else np.zeros((1, WIDTH), np.float32)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    if not len(pos) or not len(unl):
        return Model(mean, scale, np.zeros((both.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, prior)
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (pos, unl))
    theta = [rng.normal(0, (2 / p.shape[1]) ** 0.5, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta], 0
    steps = max(1, max(len(p), len(u)) // batch)
    for _ in range(epochs):
        op, ou = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(steps):
            xp, xu = (x[np.take(o, np.arange(k * batch, k * batch + min(batch, len(x))), mode="wrap")] for x, o in ((p, op), (u, ou)))
            x = np.concatenate([xp, xu])
            a = x @ theta[0] + theta[1]
            h = np.maximum(a, 0)
            g = risk_slope(h @ theta[2] + theta[3], len(xp), prior)
            dh = np.outer(g, theta[2]) * (a > 0)
            grad = [x.T @ dh + decay * theta[0], dh.sum(0), h.T @ g + decay * theta[2], np.array([g.sum()])]
            t += 1
            for i, d in enumerate(grad):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]), prior)


def held_out(key: str = "doc_id"):
    """True for the third of the rows (crc32 of the id as text, remainder 1) whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, n_positive: int = N_POSITIVE, n_unlabelled: int = N_UNLABELLED) -> Model:
    """Fits the model from rows outside the held-out fold.

    Positives: rows labelled 1. Unlabelled: rows without any label. No label 0 is used: the prior is
    ``estimated_prior`` of these rows. The fit uses the ``n_positive`` and ``n_unlabelled`` rows of each kind
    with the smallest hashed ids: at most so many feature rows reach the driver, whatever the size of the
    corpus. Of rows that repeat an id the one with the smallest features counts. Rows without an id train
    nothing; without positives or unlabelled rows every score is 0.5. Columns besides doc_id and text are not read.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    order = F.xxhash64("doc_id", F.lit(17))
    pos = marks.where("quality = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(n_positive)
    free = docs.select("doc_id").where("doc_id is not null").where(~held_out()).join(labels.select("doc_id"), "doc_id", "left_anti")
    ids = staged(
        pos.withColumn("_kind", F.lit(1)).unionByName(free.distinct().orderBy(order, "doc_id").limit(n_unlabelled).withColumn("_kind", F.lit(0))), "quality-ids"
    )  # n_positive + n_unlabelled ids at most, so they can be broadcast

    @arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        forget()
        return pa.array([features(t.as_py()).tobytes() for t in texts], pa.binary())

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "_kind", packed("text").alias("x")).groupBy("doc_id", "_kind").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    of = lambda kind: np.array([np.frombuffer(r.x, np.float32) for r in rows if r["_kind"] == kind]).reshape(-1, WIDTH)
    pos, unl = of(1), of(0)
    return fit_nnpu(pos, unl, estimated_prior(pos, unl))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds ``out``, the model's score of the whole text (0 to 1; null as empty). Nothing but the text enters it.

    Equal texts have equal scores, so repeated rows do. A column named ``out`` is replaced. No rows give no rows.
    """

    bounded_batches(docs.sparkSession)

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        forget()
        x = np.array([features(t.as_py()) for t in texts], np.float64).reshape(-1, WIDTH)
        return pa.array(model.score(x), pa.float64())

    return docs.withColumn(out, scored(F.col(text)))
