"""Mixing sources to target weights, in DataFrame and SQL expressions only.

The words of a source's documents, in a fixed pseudorandom order, make one stream that is cut
into blocks of `block_words`. The mix is a row of output shards of `shard_slots` slots; every
slot draws a source, which makes the source counts of a shard multinomial. The j-th slot of a
source, counted over the shards, takes the block at place j of a pseudorandom permutation of
the source's block indexes; once all are taken, the next permutation begins. Slots and blocks
are then joined by (source, block index).

Draws scatter, so a last shard settles them: draws above a source's quota are left out, and
missing ones follow in that shard. A source's words thus come within about a block of its
target. A quota is at most `most_times` permutations, so no document exceeds that either.

Permutations are swap-or-not networks: keyed, for any length, in 64-bit arithmetic, computed
for one index at a time. Stream positions and slot numbers are prefix sums in two levels, so a
source with a third of all rows is spread over many tasks. Only tables with a row per source
meet in one task.

Defined cases: a null text has size 0; documents without words take nothing; a null source is
a source of its own, the last in order; repeated rows are rows of their own; an empty table
gives no rows. All draws are hashes of the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronmap.llm.common import WORD, inputs, own_names, quoted
from patronmap.storage import store

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = 20240607
ROUNDS = 12
TASK_SLOTS = 100_000  # slots that become rows in one task, on average
BUCKET_ROWS = 500  # rows in a bucket of the two-level prefix sums, on average


@dataclass(frozen=True)
class Mix:
    """rows: a row per document with its place; sources: a row per source; slots: a row per
    slot; pieces: a row per document and block, with the words and how often they are taken."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """Per document: how many words the mix takes, repeats counted."""
        keys = ["s", "bucket", "place", "doc_id", "source", "size", "text_key"]
        sums = self.pieces.groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        per_source = self.sources.select("s", "source_size", "target")
        return sums.join(per_source, "s").select(
            "doc_id", "size", "source_size", "target", "taken", "source", "text_key"
        )


def running_total(df: DataFrame, group: str, bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Add the sum of `value` over the rows before, by bucket and `order`, within the group."""
    df = df.withColumn("_value", value)
    totals = df.groupBy(group, bucket).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    joined = df.join(before, [group, bucket])
    return joined.withColumn(out, F.col("_before") + own).drop("_value", "_before")


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES
) -> DataFrame:
    """Add s, weight and target to (source, source_size).

    Weights repeat over the sources in code point order, null last. Targets are
    least(cap, level * weight) for the one level at which they sum to the share, which is
    what resharing the excess by weight comes to.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cap, ratio = F.col("source_size") * float(most_times), F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy("ratio", "s")
    all_rows = Window.partitionBy()
    listed = F.array(*(F.lit(float(w)) for w in weights))
    numbered = (
        sizes.withColumn("s", F.row_number().over(by_name).cast("bigint") - 1)
        .withColumn("weight", F.get(listed, (F.col("s") % len(weights)).cast("int")))
        .withColumn("cap", cap)
        .withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(all_rows) * float(share))
    )
    capped_before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = numbered.withColumn("try", (F.col("total") - capped_before) / weight_left)
    found = F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "s", "try"))).over(all_rows)
    level = levels.withColumn("level", found["try"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    others = [c for c in sizes.columns if c not in ("source", "source_size")]
    return level.select("source", "s", "source_size", "weight", target.alias("target"), *others)


def permuted(index: Column, length: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The index that a keyed swap-or-not network of [0, length) puts in place of `index`."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), length) - x, length)
        keep = F.xxhash64(F.lit("b"), r, F.greatest(x, partner), *key).bitwiseAND(1) == 0
        return F.when(keep, x).otherwise(partner)

    return F.aggregate(F.array(*(F.lit(r) for r in range(rounds))), index, swap)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most_times: int = MOST_TIMES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """Mix the documents' words; see the module."""
    spark = docs.sparkSession
    given = inputs(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = store(
        given.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64("text").alias("text_key"),
        ),
        "sized",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    per_source = store(per_source, "sizes")
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = F.rint(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint")
    sources = store(
        source_targets(per_source, weights, share, most_times)
        .withColumn("blocks", blocks)
        .withColumn("quota", F.when(F.col("source_size") > 0, F.least(wanted, most_times * F.col("blocks"))).otherwise(0)),
        "sources",
    )

    # A source has as many buckets as its documents need.
    named = sources.select("source", "s", F.ceil(F.col("docs") / BUCKET_ROWS).alias("buckets"))
    numbered = sized.join(named, sized["source"].eqNullSafe(named["source"])).select(
        "s", sized["source"], "doc_id", "size", "text_key",
        F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), "buckets").alias("bucket"),
    )
    order = [F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "text_key"]
    rows = running_total(numbered, "s", "bucket", order, F.col("size"), "start")
    place = F.row_number().over(Window.partitionBy("s", "bucket").orderBy(*order))
    rows = rows.withColumn("place", place)

    slots = _slots(spark, sources, most_times, shard_slots, seed)
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    covered = F.when(F.col("size") > 0, F.sequence(first, last))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = rows.withColumn("block", F.explode_outer(covered)).select(
        "*", (low - F.col("start")).alias("from"), F.coalesce(high - low, F.lit(0)).alias("words")
    )
    pieces = cut.join(times, ["s", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return Mix(rows, sources, slots, pieces)


def _slots(spark, sources: DataFrame, most_times: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, number, s, block): a row per slot of the mix; number counts the slots of a source."""
    n_slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    n_shards = n_slots // shard_slots  # the rest is settled by the last shard
    # One row: sources in order with the share of draws up to and including each.
    up_to = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("quota > 0").select("s", (F.sum("quota").over(up_to) / n_slots if n_slots else F.lit(1.0)).alias("upto"))
    ladder = shares.agg(F.sort_array(F.collect_list(F.struct("upto", "s"))).alias("ladder"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "shard", "slot"), 11) / float(1 << 53)
    drawn = (
        spark.range(n_shards).select(F.col("id").alias("shard"))
        .select("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("slot"))
        .withColumn("u", draw)
        .crossJoin(F.broadcast(ladder))  # one row with an entry per source
    )
    steps = F.size(F.filter("ladder", lambda x: x["upto"] <= F.col("u")))
    chosen = F.get("ladder", F.least(steps, F.size("ladder") - 1))["s"]
    counts = drawn.select("shard", chosen.alias("s")).groupBy("shard", "s").agg(F.count("*").alias("n"))
    counts = store(counts, "draws")
    counts = counts.withColumn("part", F.expr("shard div 1000"))
    spans = running_total(counts, "s", "part", ["shard"], F.col("n"), "begin").select("shard", "s", "begin", "n")
    total = counts.groupBy("s").agg(F.sum("n").alias("begin"))
    settled = sources.where("quota > 0").select("s", "quota").join(total, "s", "left").select(
        F.lit(n_shards).cast("bigint").alias("shard"), "s", F.coalesce("begin", F.lit(0)).alias("begin"), F.col("quota").alias("n")
    )
    limits = sources.select("s", "blocks", "quota")
    spans = spans.unionByName(settled).join(F.broadcast(limits), "s")
    # The settling shard may be long: cut every span to pieces before it becomes rows.
    end = F.least("quota", F.col("begin") + F.col("n"))
    edges = F.when(end > F.col("begin"), F.sequence(F.lit(0), F.expr(f"(n - 1) div {shard_slots}")))
    cut = (
        spans.select("shard", "s", "blocks", "quota", "begin", end.alias("end"), F.explode(edges).alias("cut"))
        .withColumn("begin", F.col("begin") + F.col("cut") * shard_slots)
        .withColumn("end", F.least("end", F.col("begin") + shard_slots))
        .where("begin < end")
        .repartition(max(1, -(-n_slots // TASK_SLOTS)), "shard", "s", "cut")
    )
    numbers = cut.select("shard", "s", "blocks", F.explode(F.expr("sequence(begin, end - 1)")).alias("number"))
    turn = F.expr("number div blocks")
    block = permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("s"), turn)
    return numbers.select("shard", "number", "s", block.alias("block"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents with all columns of `docs`: a row per document and time it is taken.

    A document whose blocks are all taken keeps its text as it is; one taken in part keeps
    the words of the taken blocks, in order, with a space between them. One that the mix
    doesn't reach, or without words, goes. A column n_chars follows the text.
    """
    made = mix(docs, id_col, text_col, source_col, **options)
    keys = ["s", "bucket", "place", "doc_id", "source", "size", "text_key"]
    part = F.struct(F.col("from"), "words", "times")
    chosen = made.pieces.where("times > 0").groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    # Columns of its own get names that `docs` doesn't have.
    id_, source_, key_, copy_, size_, parts_, text_ = own_names(docs, 7)
    same = [id_, source_, key_]
    chosen = chosen.withColumnsRenamed({"doc_id": id_, "source": source_, "text_key": key_}).withColumn(
        # Repeated rows are told apart by a number; which is which makes no difference.
        copy_, F.row_number().over(Window.partitionBy(*same).orderBy("bucket", "place"))
    )
    keyed = docs.withColumns(
        {id_: F.col(quoted(id_col)), source_: F.col(quoted(source_col)), key_: F.xxhash64(quoted(text_col))}
    )
    keyed = keyed.withColumn(copy_, F.row_number().over(Window.partitionBy(*same).orderBy(key_)))
    chosen = chosen.select(*same, copy_, F.col("size").alias(size_), F.col("parts").alias(parts_))
    on = keyed[copy_] == chosen[copy_]
    for name in same:
        on = on & keyed[name].eqNullSafe(chosen[name])
    joined = keyed.join(chosen, on)
    most = F.array_max(F.transform(F.col(parts_), lambda x: x["times"]))
    turn = F.explode(F.sequence(F.lit(1).cast("bigint"), most.cast("bigint")))
    joined = joined.select(*(keyed[c] for c in map(quoted, docs.columns)), size_, parts_, turn.alias(copy_))
    joined = joined.withColumn(parts_, F.filter(parts_, lambda x: x["times"] >= F.col(copy_)))
    count = F.aggregate(parts_, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])
    whole = F.col(quoted(text_col))

    def kept(words: Column) -> Column:
        cut = F.transform(F.col(parts_), lambda x: F.slice(words, (x["from"] + 1).cast("int"), x["words"].cast("int")))
        return F.array_join(F.flatten(cut), " ")

    # The words are bound once: an expression used inside a lambda is computed for every element.
    split = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    text = F.when(count == F.col(size_), whole).otherwise(F.transform(F.array(split), kept)[0])
    out = joined.withColumn(text_, text)
    columns = {c: F.col(quoted(c)) for c in docs.columns} | {text_col: F.col(text_)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text_).cast(docs.schema["n_chars"].dataType)
    return out.select(*(value.alias(name) for name, value in columns.items()))
