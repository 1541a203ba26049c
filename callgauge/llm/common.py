"""What the operators share: reading tables, settled intermediate tables, bounded samples, joins of hot keys, Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..settling import discard, settled, shared_folder  # noqa: F401

#: The six ASCII characters that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: Rows that a pass turns into Python objects at a time.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that more than one in so many rows have is dealt over several tasks.
SPLITS = 400


def hot_join(rows: DataFrame, stats: DataFrame, on: list[str], n: str, total: int, by: list[str] | None = None, listed: bool = False) -> DataFrame:
    """Inner join of ``rows`` to ``stats``, which has one row for each key and in ``n`` how many of the ``total`` rows have it.

    Hot keys are dealt over as many tasks as their share asks for, by a hash of the columns ``by`` (all). At most ``SPLITS``
    keys are hot, so their list is broadcast; ``listed`` (for one key column of numbers and settled ``stats``) puts it into the plan,
    so that rows pass no join but the one with ``stats``.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * SPLITS / F.lit(max(1, total)))).cast("int")
    if listed:
        parts = F.pow(F.lit(2), F.ceil(F.log2(parts))).cast("int")  # few different numbers
    counted = stats.withColumn("_parts", parts)
    hot = counted.filter("_parts > 1").select(*on, "_parts")
    if listed:
        keys: dict[int, list[int]] = {}
        for key, split in hot.collect():
            keys.setdefault(split, []).append(key)
        known = rows.withColumn("_parts", F.coalesce(*(F.when(F.col(on[0]).isin(found), F.lit(split)) for split, found in keys.items()), F.lit(1)))
    else:
        known = rows.join(F.broadcast(hot), on, "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*(by or rows.columns)), F.col("_parts")).cast("int"), F.lit(0))
    dealt = known.withColumn("_salt", salt).drop("_parts")
    spread = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(spread, [*on, "_salt"]).drop("_salt")


#: Pairs of a node that are not worth a copy of its set in another task.
FEW_PAIRS = 256


def with_ends(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` and the ``column`` of both ends as a and b; ends of many pairs are dealt over tasks."""
    total, met = max(pairs.count(), SPLITS * FEW_PAIRS), pairs
    for end, name in (("src", "a"), ("dst", "b")):
        n = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n"))
        stats = table.select("node", F.col(column).alias(name)).join(n, "node").withColumnRenamed("node", end)
        met = hot_join(met, stats, [end], "n", total, by=["src", "dst"]).drop("n")
    return met


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``df`` by a hash of ``key`` (all, if there are no more), to fit a model on."""
    total = df.count()
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(total)) < bound)


def labelled_sample(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], bound: int, seed: int) -> DataFrame:
    """doc_id, text and the label columns ``names`` of about ``bound`` labelled documents, one row for each doc_id.

    Labels without an id or without any of ``names`` are left out; of repeated ids the largest
    label counts, and of their texts that of the least hash. The sample of labels is bounded, so it is broadcast and only its texts are shuffled.
    """
    known = labels.dropna(subset=["doc_id", *names]).groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    some = bounded_sample(known, "doc_id", bound, seed)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.max(n).alias(n) for n in names))


def appended(docs: DataFrame, inputs: list[str], added: str, start: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """``docs`` and the columns ``added`` (DDL), made in Arrow from the columns ``inputs``; no shuffle.

    ``start`` runs once in each task and returns the function from columns to columns. An added
    column takes the place of one of the same name.
    """
    new = StructType.fromDDL(added)
    taken = {n.lower() for n in new.names}
    kept = [c for c in docs.columns if c.lower() not in taken]
    schema = StructType([docs.schema[c] for c in kept] + new.fields)
    sent = kept + [c for c in inputs if c not in kept]
    at = [sent.index(c) for c in inputs]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for row in range(0, max(1, batch.num_rows), ROWS):  # few texts at a time are Python objects
                part = batch.slice(row, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *make(*(part.column(i) for i in at))], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, schema)
