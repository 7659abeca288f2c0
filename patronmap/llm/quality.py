"""Quality rules: counted base rules, then a calibrated logistic regression on hashed n-grams.

The base rules count words and repetitions of the whole text. The model's features are hashed
words and hashed character n-grams; it is fitted on at most `most_rows` labelled documents,
those whose ids hash smallest. One in five of them is kept out of the fit and calibrates the
margins to probabilities (Platt). Texts are scored in Arrow batches against a fixed threshold.

Defined cases: a null or empty text has no word and fails the base rules; without labelled
rows, or with one label only, the model keeps everything; repeated rows get a row each; labels
that are null or whose document is missing teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm import features
from patronmap.llm.common import fold, inputs, sample_by_hash, texts_of_sample, with_text_batches

CHAR_ORDERS = (2, 3)
CHAR_BITS = 13
WORD_BITS = 13
SIZE = (1 << CHAR_BITS) + 2 * (1 << WORD_BITS)
MOST_ROWS = 2500
KEEP_ABOVE = 0.5  # probability of label 1
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\t\n\x0b\x0c\r"
CONTINUATION = re.compile(rb"[\x80-\xbf]+")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(np.fromiter((times[w] > 1 for w in windows), dtype=bool, count=len(windows)))
    np.add.at(inside, at, 1)
    np.add.at(inside, at + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    word_chars = len(joined) - sum(map(len, CONTINUATION.findall(joined))) if not joined.isascii() else len(joined)
    symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of character n-grams, then of words and pairs of words."""
    chars = features.char_gram_buckets(text.decode("utf-8", "replace"), CHAR_ORDERS, CHAR_BITS)
    words = text.split()
    pairs = [a + b" " + b for a, b in zip(words, words[1:])]
    return np.concatenate(
        [
            features.counted(chars, 1 << CHAR_BITS),
            features.counted(features.word_buckets(words, WORD_BITS), 1 << WORD_BITS),
            features.counted(features.word_buckets(pairs, WORD_BITS), 1 << WORD_BITS),
        ]
    )


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    intercept: float
    a: float
    b: float

    def probability(self, text: bytes) -> float:
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        roots = np.sqrt(counts[at] / max(float(counts[at].sum()), 1.0))
        margin = float(roots @ self.weights[at]) + self.intercept
        return float(features.sigmoid(np.float64(self.a * margin + self.b)))


def fit(parts: list, labels: np.ndarray, calibrates: np.ndarray) -> QualityModel:
    """Margins from the rows that don't calibrate, probabilities from those that do; rows as `sparse` makes them."""
    known = labels[~calibrates]
    if len(set(known.tolist())) < 2 or not calibrates.any():
        return QualityModel(np.zeros(SIZE, np.float32), 0.0, 0.0, 40.0)
    x, rest = (features.sparse_roots([p for p, c in zip(parts, calibrates) if c == side], SIZE) for side in (False, True))
    weights, intercepts = features.fit_logistic(x, known[:, None].astype(np.float32), l2=1e-6, steps=200)
    margins = (rest @ weights)[:, 0] + intercepts[0]
    a, b = features.fit_platt(margins.astype(np.float64), labels[calibrates])
    return QualityModel(weights[:, 0], float(intercepts[0]), max(a, 0.0), b)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """At most `most_rows` of (doc_id, label, text), those whose ids hash smallest, each id once."""
    known = labels.select("doc_id", F.col(label).alias("label")).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("all", F.lit(1))
    known = sample_by_hash(known, "all", "doc_id", most_rows).select("doc_id", "label")
    return texts_of_sample(docs, known, "doc_id")


def fit_on(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    def work(texts, _):
        rows = [features.sparse(gram_counts(t or b"")) for t in texts]
        return {"part": pa.array(rows, pa.struct([("at", pa.binary()), ("n", pa.binary())]))}

    sample = labelled_texts(docs, labels, "quality", most_rows).withColumn("calibrates", fold(F.col("doc_id"), 5) == 0)
    made = with_text_batches(sample, "text", "part struct<at: binary, n: binary>", work).collect()  # bounded sample
    made.sort(key=lambda r: str(r["doc_id"]))
    labels_found = np.array([float(r["label"] > 0) for r in made])
    calibrates = np.array([bool(r["calibrates"]) for r in made], dtype=bool)
    return fit([r["part"] for r in made], labels_found, calibrates)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = MOST_ROWS,
    keep_above: float = KEEP_ABOVE,
) -> DataFrame:
    """A row per document: the base counts, base_failed, probability and kept."""
    rows = inputs(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(rows, labels, most_rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(texts, _):
        base = np.array([base_counts(t or b"") for t in texts], dtype=np.int64)
        found = np.array([shared.value.probability(t or b"") for t in texts], dtype=np.float64)
        return {n: base[:, i] for i, n in enumerate(names)} | {"probability": found}

    made = with_text_batches(rows, "text", ", ".join(f"{n} bigint" for n in names) + ", probability double", work)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    made = made.withColumn("base_failed", failed)
    return made.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_above))
