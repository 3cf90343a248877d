"""Incremental n-gram counts and labels of a stream of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.ngrams import occurrences
from ..plans.tables import shared_dir

_SUMMARY = "ngram string, cnt long, prev_count long, prev_min int, prev_max int, next_count long, next_min int, next_max int, whole boolean"


class StreamingLabels:
    """Counts and labels of n-grams over all texts seen, each distinct text once.

    A micro-batch adds one summary: for each n-gram of its new texts, the count and the number, least and greatest of the
    characters before and after it. Summaries merge by sums and extremes, so counts and closedness over all batches are one
    aggregation, and a batch writes only what its own texts hold; nothing written before is read for it but the texts, to
    leave out known ones. Batches bear their numbers: one that runs again, or in a new process after a restart, starts
    from the batches before it and writes the same again. compact() puts many small batches into one.
    """

    def __init__(self, spark: SparkSession, max_n: int | None = None, root: str | None = None):
        self.spark, self.max_n = spark, max_n
        self.root = root or f"{shared_dir(spark)}/spanweave/stream-{uuid.uuid4().hex}"
        self.progress: list[dict] = []

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, before: int | None = None) -> list[int]:
        """Numbers of the whole batches (before one)."""
        path, fs = self._path("texts")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = sorted(int(n) for n in names if fs.exists(self._path("texts", n, "_SUCCESS")[0]))
        return [n for n in done if before is None or n < before]

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{n}" for n in batches])

    def merge(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; progress then has its number, rows, new texts and n-grams, counted by the jobs that write them."""
        rows, texts, grams = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("rows", "texts", "ngrams"))
        size = F.count(F.lit(1)).alias("k")
        new = batch.observe(rows, size).filter(F.length("text") > 0).select("text").distinct()
        new = new.join(self._read("texts", self.batches(number), "text string"), "text", "left_anti")
        new.observe(texts, size).write.mode("overwrite").parquet(f"{self.root}/new/{number}")
        new = self.spark.read.schema("text string").parquet(f"{self.root}/new/{number}")
        occ = occurrences(new.select(F.xxhash64("text").alias("text_id"), "text"), self.max_n)
        one = occ.select("ngram", F.ascii("prev").alias("prev"), F.ascii("next").alias("next"), (F.col("prev").isNull() & F.col("next").isNull()).alias("whole"))
        sides = [f(c).alias(f"{c}_{f.__name__}") for c in ("prev", "next") for f in (F.count, F.min, F.max)]
        summary = one.groupBy("ngram").agg(F.count("*").alias("cnt"), *sides, F.max("whole").alias("whole"))
        summary.observe(grams, size).write.mode("overwrite").parquet(f"{self.root}/summary/{number}")
        new.write.mode("overwrite").parquet(f"{self.root}/texts/{number}")  # last: it marks the batch as whole
        done = {"batch": number, **{name: seen.get["k"] for name, seen in (("rows", rows), ("texts", texts), ("ngrams", grams))}}
        self.progress = [p for p in self.progress if p["batch"] != number] + [done]

    def summary(self, batches: list[int] | None = None) -> DataFrame:
        rows = self._read("summary", self.batches() if batches is None else batches, _SUMMARY)
        merged = [f(c).alias(c) for c, f in (("cnt", F.sum), ("prev_count", F.sum), ("prev_min", F.min), ("prev_max", F.max), ("next_count", F.sum), ("next_min", F.min), ("next_max", F.max), ("whole", F.max))]
        return rows.groupBy("ngram").agg(*merged)

    def compact(self) -> None:
        """Writes all whole batches as the last one of them, and removes the others."""
        done = self.batches()
        for kind, rows in (("summary", self.summary(done)), ("texts", self._read("texts", done, "text string"))):
            if len(done) > 1:
                rows.write.mode("overwrite").parquet(f"{self.root}/whole/{kind}")
        if len(done) > 1:
            # the others' marks go first: until the last batch is replaced, a restart finds no batch that counts twice
            for n in done[:-1]:
                path, fs = self._path("texts", str(n))
                fs.delete(path, True)
            for kind in ("summary", "texts"):
                path, fs = self._path(kind, str(done[-1]))
                fs.delete(path, True)
                fs.rename(self._path("whole", kind)[0], path)
            for n in done[:-1]:
                path, fs = self._path("summary", str(n))
                fs.delete(path, True)

    def run(self, texts: DataFrame) -> DataFrame:
        """Consumes all that a streaming DataFrame of (text) has now, in the batches that its source makes (as by
        maxFilesPerTrigger); ngram, n, cnt."""
        query = texts.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.counts()

    def counts(self) -> DataFrame:
        return self.summary().select("ngram", F.length("ngram").alias("n"), "cnt")

    def labels(self) -> DataFrame:
        """label(ngram, n, kind) of kinds root, leaf and frequency over all texts so far; with max_n, those up to that width."""
        d = self.summary()
        same = lambda c: F.coalesce((F.col(f"{c}_count") == F.col("cnt")) & (F.col(f"{c}_min") == F.col(f"{c}_max")), F.lit(False))
        n = F.length("ngram")
        kind = F.when(F.col("whole"), "root").when(n == 1, "leaf").otherwise("frequency")
        return d.filter(F.col("whole") | (n == 1) | (~same("prev") & ~same("next"))).select("ngram", n.alias("n"), kind.alias("kind"))


class StreamingCounts(StreamingLabels):
    """The counts alone, by the name that they had before labels were kept."""
