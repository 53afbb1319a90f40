"""Sources: literal rows, pull functions, files with digests."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import FlowError


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str, ordinal: str = "_i") -> DataFrame:
    """Rows in their order, with an ordinal column."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ordinal} bigint, {schema}")


class _Part(InputPartition):
    def __init__(self, index: int):
        self.index = index


def pull_source(name: str, schema: str, pull: Callable[[int], Iterable[tuple]], partitions: int = 1) -> type[DataSource]:
    """A data source over ``pull(partition)``, an iterator that ends by itself; an exception ends the task with its error.
    Register with ``spark.dataSource.register`` and read with ``spark.read.format(name).load()``."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_Part(i) for i in range(partitions)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from pull(partition.index)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source


def verified_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, length, digest, ok): binary files with their SHA-256; ``wanted`` (path, length, digest; nulls are not checked) gives ``ok``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("digest"))
    if wanted is None:
        return files.withColumn("ok", F.lit(True))
    w = wanted.select(F.col("path"), F.col("length").alias("__l"), F.col("digest").alias("__d"))
    return files.join(w, "path", "left").select("path", "length", "digest", (F.coalesce(F.col("__l") == F.col("length"), F.lit(True)) & F.coalesce(F.col("__d") == F.col("digest"), F.lit(True))).alias("ok"))


def confined(root: str, path: str) -> str:
    """A relative path within a root; one that leads out of it, is absolute or empty is an error."""
    if not path or posixpath.isabs(path) or "\x00" in path or "\\" in path:
        raise FlowError("Validation", f"not a relative path: {path!r}")
    clean = posixpath.normpath(path)
    if clean == ".." or clean.startswith("../"):
        raise FlowError("Forbidden", f"{path!r} leads out of the root")
    return posixpath.join(root, clean)
