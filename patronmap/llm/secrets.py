"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are strings in a provider's format anywhere in a text (in JSON, CSV, an address),
values assigned to a name such as password or token, private key blocks, and any other long
run of characters with a digit. Each is described by its length, character classes and the transitions between them, entropy, how
much of it dictionary words cover, whether it looks like a path, the path of its document, and
the words beside it. A random forest, fitted on labelled findings, then says how likely the
candidate is a secret; the others are false positives.

Labelled findings may be given. Without them, findings whose format decides are labelled by
rule (a provider's prefix or a random value under a secret's name against mail addresses, card
numbers, network addresses, dates, paths, placeholders and plain words), and the forest, which
sees no rule, generalises to the rest. At most `per_label` findings of either label, those whose
ids hash smallest, are used. The dictionary is the whole words of an installed vocabulary.

Defined cases: a null or empty text has no candidate; with fewer than `LEAST_FINDINGS` of
either label there is nothing to learn from, and the score is the label, or 0 (no secret) where
there is none; repeated rows give the same findings for each; a null path has no path features; an
empty table gives no rows. Offsets count code
points. Long candidates are described by their whole text, as short ones are.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm.common import inputs, is_fold, own_names, quoted, sample_by_hash, scoped, tokenizer_path, with_text_batches
from patronmap.storage import store

DICTIONARY = "word_bpe_49k.json"
LEAST_LETTERS = 4  # of a dictionary word
LEAST_LENGTH = 12  # of a candidate that only has a digit
LEAST_ASSIGNED = 6
PER_LABEL = 1500
TREES, DEPTH, SEED = 30, 8, 5
LEAST_FINDINGS = 5  # of either label; a forest cannot tell fewer from chance
IS_SECRET = 0.5
NEIGHBOURS = 32  # buckets of either neighbouring word
BEFORE = 40  # characters before a candidate in which a listed name is noticed
MARK = "<SECRET>"

# Names of secrets, prefixes that providers publish, words of placeholders.
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "credential", "auth")
PROVIDERS = re.compile(
    r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|glpat-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}"
    r"|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|npm_[0-9A-Za-z]{36}|(?<![_-])eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]*)"
)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "sk_live_", "AIza", "npm_", "eyJ")
# Inside a text a key begins after no letter or digit, but those of an escaped character, and ends before none.
KEY = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=\\[nrt])|(?<=%[0-9A-Fa-f]{2}))" + PROVIDERS.pattern + r"(?![0-9A-Za-z])")
PLACEHOLDERS = ("example", "changeme", "placeholder", "dummy", "sample", "xxxx", "your_", "<", "${", "****")

ASSIGNED = re.compile(r"(?i:" + "|".join(NAMES) + r")[\w-]{0,20}[\"']?\s{0,3}[:=]\s{0,3}([\"']?)([^\s\"',;]{6,})")
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
RUN = re.compile(r"\S+")
DIGIT = re.compile(r"\d")
EDGES = "\"'`()[]{}<>.,;:!?"
MAIL = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+")
ADDRESS = re.compile(r"\d{1,3}(\.\d{1,3}){3}(:\d+)?")
NUMBER = re.compile(r"[+\d][\d .()/:-]*")
PATHLIKE = re.compile(r"(https?://|www\.|[./~]|[A-Za-z]:\\).*|.*\.(html?|php|py|js|css|json|txt|md|png|jpe?g)")
LETTERS = re.compile(r"[^\W\d_]+")

FIELDS = "start int, length int, rule string, label int, features array<double>"


@functools.lru_cache(maxsize=1)
def dictionary(path: str) -> frozenset[str]:
    """Whole words of the vocabulary, of `LEAST_LETTERS` and more."""
    from tokenizers import Tokenizer

    ends = (w.removesuffix("</w>") for w in Tokenizer.from_file(path).get_vocab() if w.endswith("</w>"))
    return frozenset(w for w in ends if len(w) >= LEAST_LETTERS and w.isascii() and w.isalpha())


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Spans from a mark that begins a private key to the next that ends one, none inside another."""
    ends = [m.span() for m in KEY_END.finditer(text)]
    found: list[tuple[int, int]] = []
    for begin in KEY_BEGIN.finditer(text):
        if found and begin.start() < found[-1][1]:
            continue
        at = bisect.bisect_left(ends, begin.end(), key=lambda span: span[0])
        if at == len(ends):
            break
        found.append((begin.start(), ends[at][1]))
    return found


class Spans(list):
    """(start, end, rule), in order and apart."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        super().__init__(sorted(spans))
        self.ends = [end for _, end, _ in self]

    def outside(self, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of a stretch of text that no span covers."""
        parts = []
        for at in range(bisect.bisect_right(self.ends, start), len(self)):
            if self[at][0] >= end:
                break
            if self[at][0] > start:
                parts.append((start, self[at][0]))
            start = self[at][1]
        return parts + [(start, end)] if start < end else parts


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the candidates, in order and apart.

    Key blocks come first, then keys of providers wherever they stand, then what is left of
    assigned values, then what is left of runs.
    """
    found = Spans([(*s, "key_block") for s in key_blocks(text)] if "PRIVATE KEY-----" in text else [])
    if any(prefix in text for prefix in PREFIXES):
        keys = [m.span() for m in KEY.finditer(text)]
        found = Spans(found + [(*span, "provider") for span in keys if found.outside(*span) == [span]])
    low = text.lower()
    if any(name in low for name in NAMES):
        parts = [part for m in ASSIGNED.finditer(text) for part in found.outside(*m.span(2))]
        found = Spans(found + [(start, end, "assigned") for start, end in parts if end - start >= LEAST_ASSIGNED])
    runs: list[tuple[int, int, str]] = []
    at = 0
    while (digit := DIGIT.search(text, at)) is not None:
        start = max(at, *(text.rfind(space, at, digit.start()) + 1 for space in " \n\t\r"))
        run = RUN.search(text, start)
        at = run.end()
        for start, end in found.outside(*run.span()):
            part = text[start:end]
            begin = start + len(part) - len(part.lstrip(EDGES))
            part = part.strip(EDGES)
            if len(part) >= LEAST_LENGTH and DIGIT.search(part):
                runs.append((begin, begin + len(part), "run"))
    return sorted(found + runs)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def rule_label(value: str, rule: str) -> int | None:
    """1 for a secret, 0 for none, where the format decides."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS):
        return 0
    if rule in ("provider", "key_block"):
        return 1
    if MAIL.fullmatch(value) or ADDRESS.fullmatch(value) or NUMBER.fullmatch(value) or PATHLIKE.fullmatch(value):
        return 0
    if rule == "assigned":
        return 1 if len(value) >= 8 and entropy(value) >= 2.5 and DIGIT.search(value) else 0 if value.isalpha() else None
    return 0 if value.isdigit() else None


@functools.lru_cache(maxsize=4)
def longest_of(words: frozenset[str]) -> int:
    return max(map(len, words), default=0)


def coverage(value: str, words: frozenset[str]) -> float:
    """The share of characters in dictionary words, longest first from the left."""
    covered, longest = 0, longest_of(words)
    for run in LETTERS.findall(value.lower()):
        at = 0
        while at <= len(run) - LEAST_LETTERS:
            for end in range(min(len(run), at + longest), at + LEAST_LETTERS - 1, -1):
                if run[at:end] in words:
                    covered += end - at
                    at = end
                    break
            else:
                at += 1
    return covered / max(1, len(value))


def _kind(ch: str) -> int:
    return 0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3


def _neighbour(word: str) -> list[float]:
    out = [0.0] * NEIGHBOURS
    if word:
        out[zlib.crc32(word.encode("utf-8", "surrogatepass")) % NEIGHBOURS] = 1.0
    return out


def neighbours(text: str, runs: list[tuple[int, int]], start: int, end: int) -> tuple[str, str]:
    """The nearest runs of letters before and behind a candidate, whole but for what the candidate takes."""
    left = bisect.bisect_left(runs, start, key=lambda run: run[0]) - 1
    right = bisect.bisect_right(runs, end, key=lambda run: run[1])
    before = text[runs[left][0] : min(runs[left][1], start)] if left >= 0 else ""
    after = text[max(runs[right][0], end) : runs[right][1]] if right < len(runs) else ""
    return before.lower(), after.lower()


def describe(
    text: str, start: int, end: int, path: str | None, words: frozenset[str], runs: list[tuple[int, int]] | None = None
) -> list[float]:
    """Features of a candidate; `runs` are the spans of all runs of letters in the text, if known."""
    runs = [m.span() for m in LETTERS.finditer(text)] if runs is None else runs
    value, n = text[start:end], end - start
    kinds = [_kind(c) for c in value]
    shares = [kinds.count(k) / len(kinds) for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(kinds) - 1)
    letters = max((len(x) for x in LETTERS.findall(value)), default=0)
    before = text[max(0, start - BEFORE) : start]
    bare = before.rstrip("\"' ")
    left, right = neighbours(text, runs, start, end)
    where = (path or "").lower()
    return [
        float(n), math.log2(1 + n), changes, *shares,
        len(set(value)) / n, entropy(value),
        float(all(c in "0123456789abcdef" for c in value.lower())), float(value.isdigit()),
        coverage(value, words), letters / n,
        float(value.count("/")), float(value.count(".")), float("@" in value), float(bool(PATHLIKE.fullmatch(value))),
        float(bare.endswith((":", "="))), float(before.endswith(("\"", "'"))),
        float(any(name in before.lower() for name in NAMES)),
        float(any(x in where for x in ("test", "example", "doc", "fixture"))), where.count("/") * 1.0, float(len(where) > 0),
        *_neighbour(left), *_neighbour(right),
    ]


def find(rows: DataFrame, dictionary_path: str) -> DataFrame:
    """A row per candidate of (text, path, others): the others, start, length, rule, label, features."""
    kept = [c for c in rows.columns if c not in ("text", "path")]

    def work(texts, batch):
        words = dictionary(dictionary_path)
        out = []
        for raw, path in zip(texts, batch.column("path").to_pylist()):
            text = (raw or b"").decode("utf-8", "replace")
            found = candidates(text)
            runs = [m.span() for m in LETTERS.finditer(text)] if found else []
            out.append(
                [
                    {"start": s, "length": e - s, "rule": r, "label": rule_label(text[s:e], r), "features": describe(text, s, e, path, words, runs)}
                    for s, e, r in found
                ]
            )
        kind = pa.struct(
            [("start", pa.int32()), ("length", pa.int32()), ("rule", pa.string()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))]
        )
        return {"found": pa.array(out, pa.list_(kind))}

    made = with_text_batches(rows, "text", f"found array<struct<{FIELDS.replace(' ', ': ').replace(',: ', ', ')}>>", work)
    return made.select(*kept, F.inline("found"))


def fit_forest(findings: DataFrame, per_label: int = PER_LABEL):
    """A forest from (key, start, label, features), or None with too few findings.

    The labels weigh the same, however many findings they have.
    """
    known = findings.where("label is not null and features is not null")
    sample = sample_by_hash(known, "label", "key", per_label)
    # Bounded, in one partition and in order, so that the draws of the forest are the same each time.
    one = store(sample.select("key", "start", F.col("label").cast("double"), "features"), "findings")
    n = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    if len(n) < 2 or min(n.values()) < LEAST_FINDINGS:
        return None
    one = one.orderBy("label", F.xxhash64("key"), "key", "start").coalesce(1)
    weight = F.when(F.col("label") == 1.0, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values())
    one = one.select("label", weight.alias("weight"), array_to_vector("features").alias("vector"))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        probabilityCol="shares",
    )
    return forest.fit(one)


def classify(found: DataFrame, model) -> DataFrame:
    """Add score and is_secret, drop the features."""
    if model is None:
        scored = found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features")))
        scored = scored.withColumn("score", vector_to_array("shares")[1])
        scored = scored.drop("vector", "shares", "rawPrediction", "prediction")
    return scored.drop("features").withColumn("is_secret", F.col("score") >= IS_SECRET)


@scoped("findings")
def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    folds: int = 5,
    held_out: int = 0,
    per_label: int = PER_LABEL,
    dictionary_path: str | None = None,
) -> DataFrame:
    """A row per candidate: doc_id, text_key, start, length, rule, label, held_out, score, is_secret.

    `findings` are labelled rows of (doc_id, start, label) that replace the labels by rule. The
    held-out fold teaches nothing.
    """
    names = {"doc_id": id_col, "text": text_col} | ({"path": path_col} if path_col else {})
    rows = inputs(docs, **names)
    rows = rows.withColumns({"text_key": F.xxhash64("text")} | ({} if path_col else {"path": F.lit(None).cast("string")}))
    rows = rows.withColumn("path", F.col("path").cast("string"))
    found = store(find(rows, dictionary_path or tokenizer_path(DICTIONARY)), "candidates")
    if findings is not None:
        given = findings.select("doc_id", "start", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id", "start"])
        found = found.drop("label").join(given, ["doc_id", "start"], "left")
    found = found.withColumn("held_out", is_fold(F.col("doc_id"), folds, held_out))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_key").cast("string"), F.col("start").cast("string"))
    model = fit_forest(found.where(~F.col("held_out")).withColumn("key", key), per_label)
    return classify(found, model).select(
        "doc_id", "text_key", "start", "length", "rule", "label", "held_out", "score", "is_secret"
    )


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", **options) -> DataFrame:
    """The rows of `docs` with `MARK` in place of the secrets found; a column n_chars follows the text."""
    found = scan(docs, None, id_col, text_col, path_col, **options).where("is_secret")
    id_, key_, spans_, text_, doc_, hash_ = own_names(docs, 6)
    spans = (
        found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), "start", "length").distinct()
        .groupBy(id_, key_).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias(spans_))
    )
    keyed = docs.withColumns({doc_: F.col(quoted(id_col)), hash_: F.xxhash64(quoted(text_col))})
    on = keyed[doc_].eqNullSafe(spans[id_]) & keyed[hash_].eqNullSafe(spans[key_])
    text = F.col(quoted(text_col))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, span):
        between = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        return F.struct((span["start"] + span["length"]).alias("at"), F.concat(s["out"], between, F.lit(MARK)).alias("out"))

    def rest(s):
        return F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1)))

    unchanged = F.col(spans_).isNull()
    made = F.when(unchanged, text).otherwise(F.aggregate(spans_, state, step, rest))
    out = keyed.join(spans, on, "left").withColumn(text_, made)
    columns = {c: F.col(quoted(c)) for c in docs.columns} | {text_col: F.col(text_)}
    if "n_chars" in docs.columns:
        length = F.length(text_).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(unchanged, F.col("n_chars")).otherwise(length)
    return out.select(*(value.alias(name) for name, value in columns.items()))
