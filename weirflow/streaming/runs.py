"""Streams that are run to their end: all there is now is read, in micro-batches, and the result is a table in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files (a folder, or one file) as a stream, with the schema they have now."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)


def in_files(df: DataFrame, by: Sequence[str], parts: int) -> str:
    """``df`` as files of consecutive ranges of ``by`` in the shared folder, written one after the other as a source would write them."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/weirflow-files/{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(parts, *by)
    placed = cut(ranged.withColumn("__p", F.spark_partition_id()))
    for i in range(parts):
        placed.where(F.col("__p") == i).drop("__p").coalesce(1).write.mode("append").parquet(folder)
    return folder


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result. ``append`` goes to a file sink; other modes replace the whole result with each batch's."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/weirflow-streams/{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        if mode == "append":
            q = w.format("parquet").option("path", f"{folder}/out").start()
        else:
            q = w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out")).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")
