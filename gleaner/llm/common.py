"""What the operators share: reading tables, Arrow maps that keep columns, label samples."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import gleaner.llm

# Tasks carry these helpers with them: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(gleaner.llm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def map_columns(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], dict[str, pa.Array] | tuple[dict[str, pa.Array], pa.Array]],
    fields: list[StructField],
    keep: Iterable[str],
    inputs: Iterable[str],
) -> DataFrame:
    """``keep`` columns followed by the columns that ``fn`` makes of each Arrow batch.

    A kept column with the name of a made one gives way to it. ``fn`` may return a pair:
    the made columns and a boolean mask of the rows to keep.
    """
    made = [f.name for f in fields]
    taken = {n.lower() for n in made}
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in taken]
    hidden = {c: f"__in_{i}" for i, c in enumerate(dict.fromkeys(inputs))}
    plain = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    schema = StructType([df.schema[c] for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            view = pa.RecordBatch.from_arrays([b.column(h) for h in hidden.values()], names=list(hidden))
            out = fn(view)
            mask = None
            if isinstance(out, tuple):
                out, mask = out
            got = pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [out[n] for n in made], names=kept + made)
            yield got if mask is None else got.filter(mask)

    return plain.mapInArrow(run, schema)


def label_sample(docs: DataFrame, labels: DataFrame, label: str, held_out_of: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents (text, y), the same for equal tables.

    Rows of ``labels`` whose crc32(doc_id) mod ``held_out_of`` is 0 never come in; the ids
    with the least hashes are taken, so the choice does not depend on the order of rows.
    The chosen ids are at most ``rows``, which bounds the broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("__y"))
        .filter(F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1) & (text_id() % held_out_of != 0))
        .groupBy("doc_id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id")
        .limit(rows)
    )
    d = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        d.join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")  # copies of a row count once
        .agg(F.min("text").alias("text"), F.max("__y").alias("y"))
        .select("doc_id", "text", "y")
    )


def in_one_task(df: DataFrame, train: Callable[[pa.Table], bytes]) -> bytes:
    """``train`` on a bounded table in a single task; its result, a few hundred KB, comes back."""
    names = df.columns
    arrow_schema = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        t = pa.Table.from_batches(got) if got else arrow_schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([train(t.select(names))], pa.binary())], names=["model"])

    row = df.coalesce(1).mapInArrow(run, "model binary").first()
    return row["model"] if row is not None else train(arrow_schema.empty_table())  # no partition at all


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again from there."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a shared folder")
        folder = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    path = os.path.join(folder, f"gleaner-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
