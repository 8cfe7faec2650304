"""Session settings, table reading and lineage cuts for the corpus operators."""

from __future__ import annotations

import gc
import os
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, since single texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read only by Spark."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is named, a local session gets a folder of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def unused(name: str, df: DataFrame) -> str:
    """A column name that df does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_spread(rows: DataFrame, named: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """rows joined with named on a key that is unique in named and may be very frequent in rows.

    At most ``share`` keys can each hold more than one of ``share`` parts of the rows: those are broadcast, all others shuffled.
    """
    counts = rows.groupBy(key).count()
    total = rows.count()
    hot = keep(named.join(counts.where(F.col("count") * share > total).select(key), key, "left_semi"), "hot-keys")
    often = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(often, key, "left_anti").join(named, key))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, rows: int) -> DataFrame:
    """A kept table, to be broadcast where it has no more rows than that, and joined by an exchange beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Lets go of finished steps now: of their plans on the driver and, once those are collected, of their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes what keep() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_fold(doc_id: str, folds: int):
    """The contract's fold of a row: crc32 of the decimal doc_id, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` of df's keys, chosen by a hash of the key, with one row each (the least); all keys when there are no more.

    The hash decides each key by itself, so the choice is the same on every run
    and at every partitioning, and a key of very many rows counts once. Null keys
    are left out. The distinct keys are estimated to about one per cent, so the
    count of rows lies within that and five standard deviations of the draw.
    """
    df = df.where(F.col(key).isNotNull())
    n = df.select(F.approx_count_distinct(key, 0.01).alias("n")).first()["n"]
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(F.lit(20), F.col(key)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    return one_each(df, key)


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, the least; repeated ones are dropped where the rows are."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def trained(rows: DataFrame, train):
    """What ``train`` makes of a bounded sample, computed by one task: it takes the sample as a list of Arrow batches. Only the result comes to the driver."""

    def run(batches):
        held = list(batches)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(held))], pa.binary())})

    made = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([])  # no task runs over an empty sample


def crc32(data) -> int:
    import zlib

    return zlib.crc32(data) & 0xFFFFFFFF


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))
