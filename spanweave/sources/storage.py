"""A store of labelling images (the tables of a parsed corpus) by key, with read-through caching."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class StorageError(Exception):
    """An image cannot be stored or loaded."""


class NotFoundError(StorageError):
    """No image has this key."""


class SerializeError(StorageError):
    """A table of an image has a column that Parquet has no type for."""


class DeserializeError(StorageError):
    """What is stored under a key is no image: a folder of it is no Parquet table."""


class UnavailableError(StorageError):
    """The store's file system cannot be reached."""


class ImageStore:
    """Images as folders of Parquet tables below one root, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True):
        self.spark, self.root, self.enabled = spark, root.rstrip("/"), enabled

    def _path(self, key: str):
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
            return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        except Py4JJavaError as cause:
            raise UnavailableError(f"{self.root}: {cause.java_exception.getMessage()}") from cause

    def exists(self, key: str) -> bool:
        path, fs = self._path(key)
        return bool(fs.exists(path))

    def remove(self, key: str) -> None:
        path, fs = self._path(key)
        fs.delete(path, True)

    def store(self, key: str, tables: dict[str, DataFrame]) -> None:
        """Tables are written to a folder beside the image and appear under its key at once, by a rename."""
        aside = f".{key}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            try:
                df.write.parquet(f"{self.root}/{aside}/{name}")
            except AnalysisException as cause:
                raise SerializeError(f"{name} of {key}: {cause}") from cause
        path, fs = self._path(key)
        fs.mkdirs(path.getParent())
        fs.delete(path, True)
        if not fs.rename(self._path(aside)[0], path):
            fs.delete(self._path(aside)[0], True)
            raise StorageError(f"{key} cannot be renamed into place")

    def load(self, key: str) -> dict[str, DataFrame]:
        if not self.exists(key):
            raise NotFoundError(key)
        path, fs = self._path(key)
        try:
            return {s.getPath().getName(): self.spark.read.parquet(str(s.getPath())) for s in fs.listStatus(path)}
        except (AnalysisException, Py4JJavaError) as cause:
            raise DeserializeError(f"{key}: {cause}") from cause

    def through(self, key: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The stored image, or else a built one, which is stored if the cache is enabled."""
        if not self.enabled:
            return build()
        if not self.exists(key):
            self.store(key, build())
        return self.load(key)


def bucketed(df: DataFrame, table: str, key: str = "ngram", buckets: int = 64) -> DataFrame:
    """df as a table of the warehouse, dealt to buckets by a column and sorted in them: joins and groupings of such tables on that
    column, with as many buckets, move no rows. An image's vocab, labels and edges are joined on their n-grams again and again."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
