"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a logistic regression on hashed
character n-grams of the whole text says how likely the bit is +1. Decoding adds up, for each
codeword, the logistic losses of its bits, each weighted by how well that bit's classifier did
on training rows, and takes the codeword of least loss. The losses give a score; a small
distance to the second codeword marks the text as ambiguous.

Up to five languages have all different bits there are; more have random balanced codewords,
the best of some draws by smallest distance.

The classifiers are fitted on at most `per_language` labelled documents of a language (and
`most_rows` in all), those whose ids hash smallest, each as a whole and as two spans, so that
short texts are known as well. Whole texts are scored in Arrow batches.

Defined cases: a text that is null or has no letter is `und`, with score 0; without any
labelled document every text is; with one language that is the answer, with score 1; repeated
rows get a row each; null labels teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm import features
from patronmap.llm.common import Batches, Texts, inputs, is_fold, sample_by_hash, texts_of_sample, with_text_batches

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 12
PER_LANGUAGE = 200
MOST_ROWS = 4000
SPANS = (60, 300)  # characters
AMBIGUOUS = 0.1  # least difference of the two best scores
LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers such as a half


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n different rows of +1 and -1, far apart."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 5:
        columns = range(1, 1 << (n - 1))  # the first language always has +1
        return np.array([[1] * len(columns)] + [[-1 if c >> i & 1 else 1 for c in columns] for i in range(n - 1)], dtype=np.int8)
    draw = np.random.default_rng(seed)
    length, best, far = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(50):
        half = np.arange(n)[:, None] % 2 * 2 - 1
        code = draw.permuted(np.repeat(half, length, axis=1), axis=0).astype(np.int8)
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2
        np.fill_diagonal(apart, length)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def gram_counts(text: str) -> np.ndarray:
    return features.counted(features.char_gram_buckets(text.lower(), ORDERS, BITS), 1 << BITS)


@dataclass(frozen=True)
class LanguageCode:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    bit_weights: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Rows of scores per language, which sum to one."""
        margins = features.unit_roots(counts) @ self.weights + self.intercepts
        losses = np.stack([np.logaddexp(0, -word * margins) @ self.bit_weights for word in self.code], axis=1)
        shares = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return shares / shares.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str]) -> LanguageCode:
    languages = tuple(sorted(set(labels)))
    code = codewords(len(languages))
    of = np.array([languages.index(x) for x in labels], dtype=np.int64)
    wanted = (code[of] > 0).astype(np.float32) if len(of) else np.zeros((0, code.shape[1]), np.float32)
    if not code.shape[1]:
        return LanguageCode(languages, code, np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(0))
    x = features.unit_roots(counts)
    weights, intercepts = features.fit_logistic(x, wanted)
    right = ((x @ weights + intercepts > 0) == (wanted > 0.5)).mean(axis=0)
    odds = np.log((right + 0.01) / (1.01 - right))
    return LanguageCode(languages, code, weights, intercepts, np.maximum(odds, 0.01) / np.maximum(odds, 0.01).mean())


def training_rows(rows: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> DataFrame:
    """A bounded sample of (doc_id, lang, text) for training; a document with copies is taken once."""
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    n = labelled.select("lang").distinct().count()
    keys = sample_by_hash(labelled.select("doc_id", "lang"), "lang", "doc_id", min(per_language, -(-most_rows // max(1, n))))
    return texts_of_sample(labelled, keys, "doc_id", "lang")  # at most most_rows + n rows


def fit_on(rows: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> LanguageCode:
    def work(texts, batch):
        out = {"parts": []}
        for raw, one in zip(texts, batch.column("doc_id").to_pylist()):
            text = raw.decode("utf-8", "replace")
            parts = [text]
            for k, span in enumerate(SPANS):
                start = zlib.crc32(f"{one}:{k}".encode()) % max(1, len(text) - span)
                parts.append(text[start : start + span])
            out["parts"].append([features.sparse(gram_counts(p)) for p in parts if has_letter(p)])
        return {"parts": pa.array(out["parts"], pa.list_(pa.struct([("at", pa.binary()), ("n", pa.binary())])))}

    sample = training_rows(rows, per_language, most_rows)
    made = with_text_batches(sample, "text", "parts array<struct<at: binary, n: binary>>", work).collect()  # bounded sample
    made.sort(key=lambda r: (str(r["lang"]), str(r["doc_id"])))
    pairs = [(part, row["lang"]) for row in made for part in row["parts"]]
    return fit(features.dense([p for p, _ in pairs], 1 << BITS), [lang for _, lang in pairs])


def decide(model: LanguageCode, texts: Texts, ambiguous: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of every text."""
    names, best, unsure = [], [np.empty(0)], [np.empty(0, dtype=bool)]
    for start in range(0, len(texts), features.ROWS):
        part = [t.decode("utf-8", "replace") if t else "" for t in texts[start : start + features.ROWS]]
        known = np.array([bool(model.languages) and has_letter(t) for t in part])
        counts = np.zeros((len(part), 1 << BITS), np.float32)
        for i in np.flatnonzero(known):
            counts[i] = gram_counts(part[i])
        shares = model.scores(counts) if model.languages else np.zeros((len(part), 1))
        order = np.sort(shares, axis=1)[:, ::-1]
        second = order[:, 1] if shares.shape[1] > 1 else np.zeros(len(part))
        names += [model.languages[i] if k else UNKNOWN for i, k in zip(shares.argmax(axis=1), known)]
        best.append(np.where(known, order[:, 0], 0.0))
        unsure.append(~known | (order[:, 0] - second < ambiguous))
    return names, np.concatenate(best).astype(np.float64), np.concatenate(unsure)


def predict(rows: DataFrame, model: LanguageCode, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """`rows` without text, with lang_pred, score and ambiguous."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(texts, _):
        names, scores, unsure = decide(shared.value, texts, ambiguous)
        return {"lang_pred": pa.array(names, pa.string()), "score": scores, "ambiguous": unsure}

    return with_text_batches(rows, "text", "lang_pred string, score double, ambiguous boolean", work)


def identify(
    docs: DataFrame,
    folds: int = 5,
    held_out: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from rows outside the held-out fold."""
    rows = inputs(docs, doc_id=id_col, text=text_col, lang=lang_col)
    rows = rows.withColumn("held_out", is_fold(F.col("doc_id"), folds, held_out))
    model = fit_on(rows.where(~F.col("held_out")).drop("held_out"), per_language)
    return predict(rows.drop("lang"), model)


def accepted_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    held_out: int = 0,
    ambiguous: float = AMBIGUOUS,
    **options,
) -> DataFrame:
    """The rows of `docs` whose language is known and not ambiguous, with all their columns."""
    rows = inputs(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit_on(rows.where(~is_fold(F.col("doc_id"), folds, held_out)), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            names, _, unsure = decide(shared.value, Texts(batch.column(text_col)), ambiguous)
            yield batch.filter(pa.array(~unsure & (np.array(names, dtype=object) != UNKNOWN)))

    return docs.mapInArrow(run, docs.schema)
