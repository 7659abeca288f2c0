"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of characters other than these six; bytes.split() cuts at the same.
WORD = r"[^\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def is_fold(key: Column, folds: int, number: int) -> Column:
    """True where the fold has this number; a null key is in no fold."""
    return F.coalesce(fold(key, folds) == number, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Rows of an Arrow batch; texts are long, and a task holds a batch several times over.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def inputs(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column clashes.

    Also lowers the session's Arrow batches to `BATCH_ROWS`, if they are larger.
    """
    if not 0 < int(df.sparkSession.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.select(*(df[quoted(given)].alias(own) for own, given in names.items()))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def own_names(df: DataFrame, n: int) -> list[str]:
    """Names of `n` columns that `df` does not have."""
    taken, found, i = {c.lower() for c in df.columns}, [], 0
    while len(found) < n:
        if (name := f"_own{i}") not in taken:
            found.append(name)
        i += 1
    return found


def scoped(name: str):
    """Let a function of a frame store what it needs, and keep only its result, stored under `name`.

    For functions whose results are small beside their inputs.
    """
    from patronmap.storage import scratch

    def wrap(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            with scratch(df.sparkSession) as scope:
                return scope.keep(function(df, *args, **options), name)

        return run

    return wrap


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class Texts:
    """The UTF-8 bytes of a text column; only a few rows at a time become Python objects."""

    ROWS = 64

    def __init__(self, texts: pa.Array):
        large = pa.types.is_large_string(texts.type)
        self.array = texts.cast(pa.large_binary() if large else pa.binary())

    def __len__(self) -> int:
        return len(self.array)

    def __getitem__(self, rows: slice) -> list[bytes | None]:
        return self.array[rows].to_pylist()

    def __iter__(self) -> Iterator[bytes | None]:
        for start in range(0, len(self), self.ROWS):
            yield from self[start : start + self.ROWS]


def with_text_batches(
    df: DataFrame,
    text: str,
    schema: str,
    work: Callable[[Texts, pa.RecordBatch], dict[str, pa.Array | np.ndarray | list]],
) -> DataFrame:
    """Run `work` on Arrow batches of a frame of a text column and others to keep.

    `work` gets the UTF-8 bytes of the texts (or None) and the batch, and returns the new
    columns; all columns but the text are passed on. `schema` names the new columns.
    """
    kept = [c for c in df.columns if c != text]
    fields = [df.schema[c] for c in kept] + T._parse_datatype_string(schema).fields
    out = T.StructType(fields)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = work(Texts(batch.column(text)), batch)
            arrays = [batch.column(c) for c in kept]
            arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])

    return df.mapInArrow(run, out)


def sample_by_hash(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most `per_label` rows of each label, those whose keys hash smallest, one row per key.

    Which keys are taken depends on the keys alone; repeated rows neither raise the chance of
    their key nor take places. A label's rows are first thinned by hash to a few times
    `per_label`, from its number of keys, so no task sorts more than that.
    """
    from pyspark.sql import Window

    keys = df.select(F.col(label).alias("_label"), key).distinct()
    counts = keys.groupBy("_label").agg(F.count("*").alias("_n"))
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    thin = (
        df.join(F.broadcast(counts), df[label] == counts["_label"])  # a row per label
        .withColumn("_hash", place)
        .where(F.col("_hash") * F.col("_n") <= 2 * per_label + 100)
        .drop("_n", "_label")
        .dropDuplicates([label, key])
    )
    order = Window.partitionBy(label).orderBy("_hash", key)
    ranked = thin.withColumn("_place", F.row_number().over(order))
    return ranked.where(F.col("_place") <= per_label).drop("_place", "_hash")


def texts_of_sample(rows: DataFrame, sample: DataFrame, *keys: str) -> DataFrame:
    """The sample's rows, which are bounded, each with one text: the smallest of those that `rows` has for its keys."""
    found = rows.select(*keys, "text").join(F.broadcast(sample), list(keys))
    return found.groupBy(*sample.columns).agg(F.min("text").alias("text"))


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """Keep a task of one core from starting threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
