"""Language-model scoring with a probabilistic suffix tree.

A text is its words (A-Z lowered) and an end, spelled in bytes: each word, a space, and a
newline for the end. The tree's states are contexts of up to `DEPTH` bytes before a symbol.
A context is tested if it occurs `LEAST_COUNT` times, whatever the size of the corpus, and kept
if its next-symbol distribution diverges from that of the context one byte shorter: if the
count times the Kullback-Leibler divergence is above `LEAST_GAIN`; contexts on the way to a
kept one are kept too. Distributions are smoothed with the shorter context's, the more the
more different symbols follow, down to the root's with a constant added. A symbol is scored in the longest kept context it follows. Sums
over the bytes of words and end are the log10 probability of the text.

Counts come from all training texts: tasks count sorted keys of a context and its symbol, and
word counts, and Spark adds them up. The kept contexts are a table that grows with the corpus.
The most frequent ones (at most `HOT_CONTEXTS`, and the root) are broadcast as a tree; a position
that goes on from there into a rarer context is passed on by its bytes, and those, once each, are
joined with the table. Which contexts are broadcast changes no score.

Each text also gets a base score from smoothed word counts. The counts of the most frequent
words (`HOT_WORDS`, of at most `HOT_BYTES`) are broadcast, the other words are joined with
their counts; none of these fills a large part of a partition.

Defined cases: a null or empty text is its end alone; without training texts the tree is a
root with equal shares; repeated rows get a row each, and count as often in training; a null
id is in no fold and teaches; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronmap.llm.common import Batches, inputs, is_fold, scoped, with_text_batches
from patronmap.storage import store

DEPTH = 5
LEAST_COUNT = 4  # occurrences of a tested context
LEAST_GAIN = 5.0
PRIOR = 3.0  # weight of the shorter context's distribution, in occurrences per different symbol
ROOT_PRIOR = 0.5
HOT_CONTEXTS = 60_000
HOT_WORDS = 200_000
HOT_BYTES = 64
COUNT_BYTES = 1 << 23  # of texts whose keys are sorted together
SCORE_BYTES = 1 << 20
COUNTED_WORDS = 400_000  # words a task counts before it passes them on
LEVEL_BIT = 8 * (DEPTH + 1)
PAD = b" " * DEPTH
END = b"\n"
NO_WORD = b""  # the end, among the words


def spell(words: list[bytes]) -> bytes:
    return b" ".join(words) + b" " + END if words else END


def _positions(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with padding before each text, which of them are symbols, where texts begin."""
    joined = np.frombuffer(b"".join([PAD + s for s in streams]), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) + DEPTH for s in streams])[:-1]]).astype(np.int64)
    symbol = np.ones(len(joined), dtype=bool)
    for i in range(DEPTH):
        symbol[starts + i] = False
    return joined, symbol, starts


def context_counts(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context << 8 | symbol, the byte before the symbol lowest in the context), counts."""
    joined, symbol, _ = _positions(streams)
    keys = joined[DEPTH:].astype(np.int64)
    for i in range(1, DEPTH + 1):
        keys |= joined[DEPTH - i : len(joined) - i].astype(np.int64) << (8 * i)
    keys = keys[symbol[DEPTH:]]
    keys.sort()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.diff(np.concatenate([edge, [len(keys)]]))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, word, n) of a column text: kind 0 counts words, kind 1 contexts and symbols."""

    def batch(kind: int, keys, words, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(counts), kind, np.int8)), pa.array(keys), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
            names=["kind", "key", "word", "n"],
        )

    def run(batches: Batches) -> Batches:
        words: Counter = Counter()
        streams, size = [], 0

        def flush_words() -> pa.RecordBatch:
            made = batch(0, np.zeros(len(words), np.int64), list(words), list(words.values()))
            words.clear()
            return made

        def flush_streams() -> pa.RecordBatch:
            keys, counts = context_counts(streams)
            return batch(1, keys, [None] * len(keys), counts)

        for one in batches:
            raw = one.column(0)
            raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
            for text in raw:
                found = (text.as_py() or b"").lower().split()
                words.update(found)
                words[NO_WORD] += 1
                streams.append(spell(found))
                size += len(streams[-1]) + DEPTH
                if size >= COUNT_BYTES:
                    yield flush_streams()
                    streams, size = [], 0
                if len(words) >= COUNTED_WORDS:
                    yield flush_words()
        if streams:
            yield flush_streams()
            yield flush_words()

    parts = texts.select("text").mapInArrow(run, "kind tinyint, key bigint, word binary, n bigint")
    return parts.groupBy("kind", "key", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class SuffixTree:
    """step: the state after one more byte of context, or the last row, from which none leads
    on; column: of a symbol; logs: log10 probabilities per state and column; rarer: whether one
    more byte leads to a context that is kept but not in this tree."""

    step: np.ndarray
    column: np.ndarray
    logs: np.ndarray
    rarer: np.ndarray

    def scores(self, streams: list[bytes]) -> np.ndarray:
        """Log10 probabilities by the contexts of this tree."""
        sums, rows, _, logs, n = self.walk(streams)
        return sums + np.bincount(rows, logs.astype(np.float64) * n, len(sums))

    def walk(self, streams: list[bytes]) -> tuple[np.ndarray, ...]:
        """Sums over the positions that end in this tree; of the others row, key, log10 probability
        in this tree and number of equal ones, by row. The key is that of `context_counts`, with the
        length of the longest context of this tree above it."""
        joined, symbol, starts = _positions(streams)
        dead = len(self.step) - 1
        columns = self.column[joined]
        state = np.zeros(len(joined) - DEPTH, dtype=np.int32)
        best = state.copy()
        level = np.zeros(len(state), dtype=np.int8)
        goes_on = np.zeros(len(state), dtype=bool)
        for i in range(1, DEPTH + 1):
            byte = columns[DEPTH - i : len(joined) - i]
            goes_on |= self.rarer[state, byte]
            state = self.step[state, byte]
            best = np.where(state != dead, state, best)
            level += state != dead
        logs = np.zeros(len(joined))
        logs[DEPTH:] = self.logs[best, columns[DEPTH:]]
        logs[~symbol] = 0.0
        at = np.flatnonzero(goes_on & symbol[DEPTH:]) + DEPTH
        rows, keys, passed = np.searchsorted(starts, at, side="right") - 1, joined[at].astype(np.int64), logs[at]
        logs[at] = 0.0
        for i in range(1, DEPTH + 1):
            keys |= joined[at - i].astype(np.int64) << (8 * i)
        keys |= level[at - DEPTH].astype(np.int64) << LEVEL_BIT
        order = np.lexsort((keys, rows))
        rows, keys, passed = rows[order], keys[order], passed[order]
        edge = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])) if len(at) else at
        n = np.diff(np.concatenate([edge, [len(at)]]))
        return np.add.reduceat(logs, starts), rows[edge], keys[edge], passed[edge].astype(np.float32), n


def build_tree(
    levels: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, rarer: tuple[np.ndarray, np.ndarray], prior: float = PRIOR
) -> SuffixTree:
    """From a row per context and symbol, the root being level 0, and (levels, contexts) one byte longer left out."""
    used = np.unique(symbols)
    column = np.full(256, len(used), dtype=np.int16)  # the last column: bytes never seen
    column[used] = np.arange(len(used))
    unseen = 256 - len(used)
    ids: dict[tuple[int, int], int] = {(0, 0): 0}
    order = np.lexsort((contexts, levels))
    levels, contexts, symbols, counts = levels[order], contexts[order], symbols[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], (levels[1:] != levels[:-1]) | (contexts[1:] != contexts[:-1])])) if len(levels) else np.empty(0, np.int64)
    ends = np.concatenate([edge[1:], [len(levels)]])
    for e in edge:
        ids.setdefault((int(levels[e]), int(contexts[e])), len(ids))
    dead = len(ids)
    step = np.full((dead + 1, len(used) + 1), dead, dtype=np.int32)
    goes_on = np.zeros(step.shape, dtype=bool)
    for level, context in zip(*(x.tolist() for x in rarer)):
        goes_on[ids[level - 1, context & ((1 << 8 * (level - 1)) - 1)], column[context >> 8 * (level - 1)]] = True
    shares = np.zeros((dead, len(used) + 1), dtype=np.float32)
    shares[0] = np.concatenate([np.full(len(used), ROOT_PRIOR), [ROOT_PRIOR * unseen]]) / (256 * ROOT_PRIOR)
    for e, f in zip(edge, ends):
        level, context = int(levels[e]), int(contexts[e])
        state = ids[level, context]
        if level:
            parent = ids[level - 1, context & ((1 << 8 * (level - 1)) - 1)]
            step[parent, column[context >> 8 * (level - 1)]] = state
            weight, base = prior * (f - e), shares[parent]
        else:
            weight, base = 256 * ROOT_PRIOR, shares[0].copy()
        own = np.zeros(len(used) + 1)
        own[column[symbols[e:f]]] = counts[e:f]
        shares[state] = (own + weight * base) / (own.sum() + weight)
    if unseen:
        shares[:, -1] /= unseen  # of one of them
    else:
        shares[:, -1] = 1.0
    return SuffixTree(step, column, np.log10(shares, out=shares), goes_on)


def _masks():
    """From the length of a context to the bits of its bytes."""
    return F.create_map(*(x for k in range(DEPTH + 1) for x in (F.lit(k), F.lit((1 << 8 * k) - 1).cast("bigint"))))


def kept_contexts(counts: DataFrame, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(level, context, symbol, n, total) of the kept contexts, from rows (key, n)."""
    masks = _masks()
    context = F.shiftright("key", 8).bitwiseAND(masks[F.col("level")])
    shown = (
        counts.select("key", "n", F.explode(F.array(*(F.lit(k) for k in range(DEPTH + 1)))).alias("level"))
        .groupBy("level", context.alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("symbol"))
        .agg(F.sum("n").alias("n"))
    )
    sums = shown.groupBy("level", "context").agg(F.sum("n").alias("total")).where((F.col("level") == 0) | (F.col("total") >= least_count))
    tested = store(shown.join(sums, ["level", "context"]), "contexts")
    shorter = tested.select(
        (F.col("level") + 1).alias("level"), F.col("context").alias("parent"), "symbol",
        F.col("n").alias("parent_n"), F.col("total").alias("parent_total"),
    )
    parent = F.col("context").bitwiseAND(masks[F.col("level") - 1])
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("parent_n") / F.col("parent_total"))))
    passed = (
        tested.where("level > 0").withColumn("parent", parent)
        .join(shorter, ["level", "parent", "symbol"])
        .groupBy("level", "context").agg(gain.alias("gain")).where(F.col("gain") > least_gain)
    )
    way = F.explode(F.sequence(F.lit(0), F.col("level")))
    kept = passed.select("context", way.alias("level")).select("level", F.col("context").bitwiseAND(masks[F.col("level")]).alias("context"))
    root = counts.sparkSession.createDataFrame([(0, 0)], "level int, context bigint")
    return tested.join(kept.union(root).distinct(), ["level", "context"], "left_semi").select("level", "context", "symbol", "n", "total")


def fit(counts: DataFrame, hot_contexts: int = HOT_CONTEXTS) -> tuple[SuffixTree, DataFrame]:
    """The tree of the most frequent kept contexts, and the others: level, context, total, kinds, following (n by symbol)."""
    following = F.map_from_entries(F.collect_list(F.struct("symbol", "n")))  # at most 256
    contexts = store(
        kept_contexts(counts).groupBy("level", "context")
        .agg(F.first("total").alias("total"), F.count("*").alias("kinds"), following.alias("following")),
        "kept",
    )
    # A context is at least as frequent as the longer ones, so those above a limit form a tree.
    size = F.floor(F.log2("total") * 16)
    limit, n = math.inf, 0
    for r in contexts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 16 * 64
        n += r["count"]
        if n > hot_contexts:
            break
        limit = r["size"]
    is_hot = (F.col("level") == 0) | (size >= F.lit(limit))
    hot, rare = contexts.where(is_hot), contexts.where(~is_hot)
    rows = hot.select("level", "context", F.explode("following").alias("symbol", "n")).toArrow()
    parents = hot.select((F.col("level") + 1).alias("level"), F.col("context").alias("parent"))
    parent = F.col("context").bitwiseAND(_masks()[F.col("level") - 1])
    edges = rare.select("level", "context", parent.alias("parent")).join(parents, ["level", "parent"], "left_semi")
    edges = edges.select("level", "context").toArrow()  # at most 256 of a context of the tree
    tree = build_tree(
        *(rows[c].to_numpy() for c in ("level", "context", "symbol", "n")), tuple(edges[c].to_numpy() for c in ("level", "context"))
    )
    return tree, rare


def fit_tree(counts: DataFrame) -> SuffixTree:
    return fit(counts)[0]


def rarer_logs(posted: DataFrame, rare: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(key, log): log10 probabilities in the longest kept context, from rows (key, log) of `SuffixTree.walk`."""
    keys = posted.groupBy("key").agg(F.first("log").alias("log"))
    level = F.explode(F.sequence(F.shiftright("key", LEVEL_BIT).cast("int") + 1, F.lit(DEPTH)))
    longer = keys.select("key", "log", level.alias("level"))
    longer = longer.withColumn("context", F.shiftright("key", 8).bitwiseAND(_masks()[F.col("level")]))
    weight = prior * F.col("kinds")
    own = F.coalesce(F.col("following")[F.col("key").bitwiseAND(255).cast("int")], F.lit(0))
    steps = longer.join(rare, ["level", "context"]).select(
        "key", "log", F.struct("level", (own / (F.col("total") + weight)).alias("own"), (weight / (F.col("total") + weight)).alias("shorter")).alias("step")
    )
    share = F.aggregate(F.sort_array(F.collect_list("step")), F.pow(F.lit(10.0), F.first("log").cast("double")), lambda s, x: x["own"] + x["shorter"] * s)
    return steps.groupBy("key").agg(F.log10(share).alias("log"))


@scoped("scores")
def score_documents(
    docs: DataFrame,
    folds: int = 10,
    held_out: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
    hot_contexts: int = HOT_CONTEXTS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = inputs(docs, doc_id=id_col, text=text_col).withColumn("held_out", is_fold(F.col("doc_id"), folds, held_out))
    counts = store(corpus_counts(rows.where(~F.col("held_out"))), "counts")
    words = counts.where("kind = 0").select("word", F.col("n").alias("c"))
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tree, rare_contexts = fit(counts.where("kind = 1").select("key", "n"), hot_contexts)
    floor = math.log10(tokens + 0.1 * (distinct + 1))
    short = words.where(F.octet_length("word") <= HOT_BYTES)
    hot = short.orderBy(F.desc("c"), "word").limit(hot_words).toArrow()  # at most hot_words of HOT_BYTES
    logs = np.log10(hot["c"].to_numpy().astype(np.float64) + 0.1) - floor
    known = dict(zip(hot["word"].to_pylist(), logs.tolist()))
    del hot, logs
    shared = spark.sparkContext.broadcast((tree, known))

    def work(texts, _):
        tree, known = shared.value
        n_tokens, n_hot, sums, scores, rare = [], [], [], [], []
        streams, size = [], 0
        rarer = []

        def flush():
            total, rows, *found = tree.walk(streams)
            scores.append(total)
            rarer.append((np.bincount(rows, minlength=len(streams)), *found))

        for text in texts:
            found = (text or b"").lower().split()
            streams.append(spell(found))
            size += len(streams[-1])
            found.append(NO_WORD)
            logs = [known.get(w) for w in found]
            missing = Counter([w for w, x in zip(found, logs) if x is None])
            n_tokens.append(len(found))
            n_hot.append(len(found) - sum(missing.values()))
            sums.append(math.fsum(x for x in logs if x is not None))
            rare.append([{"word": w, "n": n} for w, n in missing.items()])
            if size >= SCORE_BYTES:
                flush()
                streams, size = [], 0
        if streams:
            flush()
        per_row, keys, logs, n = (np.concatenate(x) for x in zip(*rarer))
        offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(keys), pa.array(logs), pa.array(n.astype(np.int32))], names=["key", "log", "n"])
        return {
            "n_tokens": np.array(n_tokens, np.int64), "n_hot": np.array(n_hot, np.int64), "hot_sum": np.array(sums, np.float64),
            "score": np.concatenate(scores).astype(np.float64),
            "rare": pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
            "rarer": pa.ListArray.from_arrays(pa.array(offsets), entries),
        }

    schema = "n_tokens bigint, n_hot bigint, hot_sum double, score double, rare array<struct<word: binary, n: bigint>>"
    schema += ", rarer array<struct<key: bigint, log: float, n: int>>"
    scored = with_text_batches(rows, "text", schema, work).withColumn("row", F.monotonically_increasing_id())
    scored = store(scored, "scored")
    posted = scored.select("row", F.inline("rare"))
    count = F.coalesce("c", F.lit(0))
    seen_words = posted.join(words, "word", "left").select(
        "row", (F.col("n") * (F.log10(count + 0.1) - floor)).alias("rare_sum"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_rare"), F.lit(0.0).alias("rarer_sum"),
    )
    passed = scored.select("row", F.inline("rarer"))
    logs = rarer_logs(passed.select("key", "log"), rare_contexts)
    seen_contexts = passed.drop("log").join(logs, "key").select(
        "row", F.lit(0.0).alias("rare_sum"), F.lit(0).cast("bigint").alias("n_rare"), (F.col("n") * F.col("log")).alias("rarer_sum")
    )
    sums = (F.sum(c).alias(c) for c in ("rare_sum", "n_rare", "rarer_sum"))
    seen = seen_words.union(seen_contexts).groupBy("row").agg(*sums)
    zero = F.lit(0)
    return scored.join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", zero)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rarer_sum", F.lit(0.0))).alias("score"),
    )
