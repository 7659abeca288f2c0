"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: its lower-case words and their beginnings of a few letters,
each hashed to a bucket. The machine scores a set by an intercept, a weight per bucket and the
inner products of the factors of all pairs of buckets, so that a pair can count for more or
less than its members. The sums over pairs come from the sums and squares of factors, in
time linear in the terms.

It is fitted on at most `per_label` labelled documents of either label, those whose ids hash
smallest, by full-batch adaptive steps on the buckets whose documents differ between the labels by
a chi-square test at the level of 0.1 %, and on those that a fifth of the documents hold, which may
differ in pairs only; there may be any number of either. The intercept is then moved to the share of
label 1 among all labelled rows. Whole texts are scored in Arrow batches.

Defined cases: a null or empty text has no term and the intercept's score; without labelled
rows of both labels the score is the share of label 1 (0 without any); repeated rows get a
row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm.common import inputs, is_fold, sample_by_hash, texts_of_sample, with_text_batches
from patronmap.llm.features import Sparse, sigmoid

BITS = 18
BEGINNINGS = (4, 5, 6)
FACTORS = 4
LEAST_DOCS = 3
COMMON = 0.2  # share of the documents
LEVEL = 10.83  # chi-square with one degree of freedom, exceeded by chance once in 1,000
PER_LABEL = 2000
STEPS = 150
THRESHOLD = 0.3
KNOWN_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Buckets of a word and of its beginnings; the lengths keep them apart."""
    mask = (1 << BITS) - 1
    raw = [word] + [f"{word[:n]}~{n}" for n in BEGINNINGS if len(word) > n]
    return [zlib.crc32(r.encode("utf-8", "surrogatepass")) & mask for r in raw]


def terms(text: bytes | None) -> np.ndarray:
    words = set(WORD.findall((text or b"").decode("utf-8", "replace").lower()))
    return np.unique(np.array([t for w in words for t in word_terms(w)], dtype=np.int64))


@dataclass(frozen=True)
class FactorizationMachine:
    """place: a row of weights and factors per bucket, -1 for those that don't count."""

    place: np.ndarray
    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, rows: np.ndarray) -> float:
        v = self.factors[rows]
        pairs = 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(self.intercept + self.weights[rows].sum() + pairs)


def choose(sets: list[np.ndarray], y: np.ndarray, level: float = LEVEL, least: int = LEAST_DOCS) -> np.ndarray:
    """The buckets that tell the labels apart by a test at a fixed level, and common ones, whose pairs may."""
    size = 1 << BITS
    with_one = np.bincount(np.concatenate([*(s for s, l in zip(sets, y) if l), np.empty(0)]).astype(np.int64), minlength=size)
    with_any = np.bincount(np.concatenate([*sets, np.empty(0)]).astype(np.int64), minlength=size)
    n, ones = len(sets), int(y.sum())
    expected = with_any * ones / max(1, n)
    spread = np.maximum(expected * (1 - ones / max(1, n)) * (1 - with_any / max(1, n)), 1e-9)
    differs = (with_any >= least) & ((with_one - expected) ** 2 / spread >= level)
    return np.flatnonzero(differs | (with_any >= max(least, COMMON * n)))


def fit(sets: list[np.ndarray], labels: np.ndarray, share: float, factors: int = FACTORS, steps: int = STEPS, seed: int = 11) -> FactorizationMachine:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    share = min(max(share, 0.0), 1.0)
    if not len(labels) or labels.min() == labels.max():
        flat = -40.0 if share <= 0 else 40.0 if share >= 1 else float(np.log(share / (1 - share)))
        return FactorizationMachine(place, flat, np.zeros(0, np.float32), np.zeros((0, factors), np.float32))
    chosen = choose(sets, labels)
    place[chosen] = np.arange(len(chosen))
    rows = [at[at >= 0] for at in (place[s] for s in sets)]
    x = Sparse(rows, [np.ones(len(r), np.float32) for r in rows], len(chosen))
    y = labels.astype(np.float32)
    draw = np.random.default_rng(seed)
    w = np.zeros(len(chosen), np.float32)
    v = (draw.standard_normal((len(chosen), factors)) * 0.01).astype(np.float32)
    b = np.zeros(1, np.float32)
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("w", w), ("v", v), ("b", b))}
    per_row = 1.0 / len(y)
    for step in range(1, steps + 1):
        xv = x @ v
        margin = b + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        error = ((sigmoid(margin) - y) * per_row).astype(np.float32)
        slopes = {
            "b": np.array([error.sum()], np.float32),
            "w": (down := x.turned_times(error)) + 1e-5 * w,
            "v": x.turned_times(error[:, None] * xv) - v * down[:, None] + 1e-5 * v,
        }
        for name, value in (("w", w), ("v", v), ("b", b)):  # adaptive steps with momentum
            mean, square = state[name]
            mean += 0.1 * (slopes[name] - mean)
            square += 0.001 * (slopes[name] ** 2 - square)
            value -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    drawn = float(y.mean())
    shift = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(drawn / (1 - drawn))
    return FactorizationMachine(place, float(b[0] + shift), w, v)


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> FactorizationMachine:
    """From (doc_id, text) and (doc_id, label)."""
    known = labels.where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = sample_by_hash(known, "label", "doc_id", per_label)  # 2 x per_label rows

    def work(texts, _):
        return {"terms": pa.array([terms(t).astype("<u4").tobytes() for t in texts], pa.binary())}

    made = with_text_batches(texts_of_sample(docs, sample, "doc_id"), "text", "terms binary", work).collect()
    made.sort(key=lambda r: str(r["doc_id"]))
    sets = [np.frombuffer(r["terms"], "<u4").astype(np.int64) for r in made]
    total = sum(counts.values())
    return fit(sets, np.array([r["label"] for r in made]), counts.get(1, 0) / total if total else 0.0)


def score_texts(rows: DataFrame, model: FactorizationMachine) -> DataFrame:
    """`rows` without text, with score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(texts, _):
        model, known, scores = shared.value, {}, []
        for text in texts:
            found: set[int] = set()
            for word in set(WORD.findall((text or b"").decode("utf-8", "replace").lower())):
                at = known.get(word)
                if at is None:
                    at = tuple(int(p) for p in model.place[word_terms(word)] if p >= 0)
                    if len(known) < KNOWN_WORDS:
                        known[word] = at
                found.update(at)
            scores.append(model.margin(np.array(sorted(found), dtype=np.int64)))
        return {"score": sigmoid(np.array(scores, dtype=np.float64))}

    return with_text_batches(rows, "text", "score double", work)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    folds: int = 4,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    per_label: int = PER_LABEL,
) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels outside the held-out fold."""
    rows = inputs(docs, doc_id=id_col, text=text_col)
    known = labels.select("doc_id", F.col(label_col).alias("label")).where(~is_fold(F.col("doc_id"), folds, held_out))
    model = fit_on(rows, known, per_label)
    found = score_texts(rows.withColumn("held_out", is_fold(F.col("doc_id"), folds, held_out)), model)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
