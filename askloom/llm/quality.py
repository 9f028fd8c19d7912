"""Quality classifier from positive and unlabelled texts.

Trusted positives are the labelled good documents; the whole corpus is the
unlabelled sample. The model minimises the non-negative unbiased risk

    prior * E_pos[loss(+1)] + max(0, E_all[loss(-1)] - prior * E_pos[loss(-1)])

with squared loss and a score that is linear in indicator features. The risk then
depends on the data through the features' second moments only, so one pass over
all rows gives it exactly and the minimum is found on a matrix of fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import mapped, texts
from askloom.session import land

THRESHOLD = 0.3
#: Shares above which a feature's indicators are on.
EDGES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
RIDGE = 1e-4
STEPS = 500

_STOPS = b".,;:!?'\")]}-%"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_UPPER = re.compile(rb"[A-Z]")
_NAMES = (
    "odd_end", "double_end", "no_letter", "repeat_next", "repeat_near", "distinct", "upper",
    "digits", "marks", "short_words", "long_words", "line_repeat", "very_short", "few_words",
)


def shares(text: str) -> list[float]:
    """Shares between 0 and 1 that describe a text, in the order of ``_NAMES``."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(_NAMES) - 2) + [1.0, 1.0]
    ends = [w[-1] for w in words]
    odd = sum(e in _ODD for e in ends)
    double = sum(len(w) > 1 and w[-2] == w[-1] and w[-1] in _MARK_SET for w in words)
    bare = sum(not w.strip(_MARKS) for w in words)
    following = sum(map(_same, words, words[1:]))
    near = sum(map(_same, words, words[2:])) + sum(map(_same, words, words[3:]))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        odd / n,
        double / n,
        bare / n,
        following / n,
        near / (2 * n),
        len(set(words)) / n,
        float(counts[65:91].sum() / max(1, letters)),
        float(counts[48:58].sum() / len(raw)),
        float(counts[list(_MARKS)].sum() / len(raw)),
        float((lengths <= 2).mean()),
        float((lengths >= 14).mean()),
        1 - len(set(lines)) / len(lines),
        1 / n,
        min(1.0, 20 / n) if n < 200 else 0.0,
    ]


_MARK_SET = frozenset(_MARKS)
_ODD = frozenset(_MARKS) - frozenset(_STOPS)


def _same(a: bytes, b: bytes) -> bool:
    return a == b


def indicators(values: np.ndarray) -> np.ndarray:
    """A column of ones, then for each share one column per edge that it exceeds."""
    on = values[:, :, None] > np.array(EDGES)
    return np.concatenate([np.ones((len(values), 1)), on.reshape(len(values), -1)], axis=1)


WIDTH = 1 + len(_NAMES) * len(EDGES)


def held_out(folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; false without an id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % folds == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, shares`` of every document."""

    def work(batch):
        return {
            "doc_id": batch.column("doc_id"),
            "shares": [shares(t) for t in batch.column("text").to_pylist()],
        }

    return mapped(texts(docs), work, "doc_id long, shares array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(_NAMES))


def moments(described: DataFrame, kind: str) -> DataFrame:
    """``kind, place, total``: sums of the products of all feature pairs."""

    def run(batches):
        total = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            if batch.num_rows:
                x = indicators(_matrix(batch.column("shares")))
                total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([kind] * len(at), pa.string()),
                "place": pa.array(at, pa.int64()),
                "total": pa.array(total.ravel()[at], pa.float64()),
            }
        )

    return described.select("shares").mapInArrow(run, "kind string, place long, total double")


def minimise(every: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk, from second-moment sums (whose first
    row holds the sums of the features)."""
    u, p = every / every[0, 0], positive / positive[0, 0]
    ridge = RIDGE * np.eye(len(u))
    ridge[0, 0] = 0

    def negative_part(w):
        loss = lambda m: w @ m @ w + 2 * w @ m[0] + 1  # noqa: E731  mean of (x.w + 1)^2
        return loss(u) - prior * loss(p)

    # Without the bound the minimum is a linear system.
    w = np.linalg.lstsq(u + ridge, 2 * prior * p[0] - u[0], rcond=None)[0]
    if negative_part(w) >= 0:
        return w
    rate = 0.5 / np.linalg.norm(u + p + ridge, 2)
    w, best, least = np.zeros(len(u)), np.zeros(len(u)), np.inf
    for _ in range(STEPS):
        rest = negative_part(w)
        good = prior * (w @ p @ w - 2 * w @ p[0] + 1)
        risk = good + max(0.0, rest) + w @ ridge @ w
        if risk < least:
            best, least = w, risk
        grad_rest = 2 * (u @ w + u[0]) - prior * 2 * (p @ w + p[0])
        grad = 2 * prior * (p @ w - p[0]) + grad_rest + 2 * ridge @ w if rest >= 0 else -grad_rest
        w = w - rate * grad
    return best


def probability(margin: np.ndarray) -> np.ndarray:
    """Chance of label 1 for a score that estimates 2 * chance - 1: linear, with
    tails that flatten out instead of leaving 0 to 1, so that order is kept."""
    p, edge = (margin + 1) / 2, 0.02
    low = edge * np.exp(np.minimum(0, (p - edge) / edge))
    high = 1 - edge * np.exp(np.minimum(0, (1 - edge - p) / edge))
    return np.where(p < edge, low, np.where(p > 1 - edge, high, p))


def fit(described: DataFrame, labels: DataFrame, folds: int = 5) -> np.ndarray:
    """Weights learned from the labels of rows that aren't held out; all such
    rows count. The class prior is the share of label 1 among them. With labels
    of one kind only there is nothing to tell apart: weights are zero."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(folds))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
    )
    share = known.agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")
    ).first()
    if not share["good"] or share["good"] == share["n"]:
        return np.zeros(WIDTH)
    good = described.join(known.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    # At most two rows for each pair of features, whatever the corpus.
    rows = (
        moments(described, "all").unionByName(moments(good, "good"))
        .groupBy("kind", "place").agg(F.sum("total").alias("total")).collect()
    )
    sums = {k: np.zeros(WIDTH * WIDTH) for k in ("all", "good")}
    for kind, place, total in rows:
        sums[kind][place] = total
    every, positive = (sums[k].reshape(WIDTH, WIDTH) for k in ("all", "good"))
    if not positive[0, 0]:
        return np.zeros(WIDTH)
    return minimise(every, positive, share["good"] / share["n"])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``labels`` holds ``doc_id, quality`` (1 good, 0 bad); rows whose crc32 of the id
    leaves no remainder by ``folds`` teach nothing. Scores come from the text alone.
    Null and empty texts count as texts without words; null ids are scored and not
    held out; of several labels for an id the largest counts. Without usable labels
    every score is 0.5. One row per row of ``docs``; other columns are ignored.
    Runs jobs: features are stored once.
    """
    described = land(features(docs), "features")
    weights = fit(described, labels, folds)

    def work(batch):
        p = probability(indicators(_matrix(batch.column("shares"))) @ weights)
        return {"doc_id": batch.column("doc_id"), "score": p}

    return mapped(described, work, "doc_id long, score double").select(
        "doc_id",
        held_out(folds).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted bad, all columns kept. Every row is judged
    by its own text, whatever its id. Runs jobs; a text is described once to learn and
    once to judge it, so that no texts are stored."""
    weights = fit(land(features(docs), "features"), labels)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        values = np.array([shares(t) for t in text.to_pylist()]).reshape(-1, len(_NAMES))
        return pa.array(probability(indicators(values) @ weights) >= THRESHOLD)

    return docs.where(good(F.coalesce(F.col("text").cast("string"), F.lit(""))))
