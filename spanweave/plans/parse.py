"""From a corpus to its labels and partition grammar, stage by stage."""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import containment, labels, partition, whole
from ..sources.corpus import non_empty
from .tables import settle


class Stage(enum.IntEnum):
    EMPTY, CONTAINMENT, FREQUENCY, WRAPPERS, PARTITIONS, FINISHED = range(6)


class Cancelled(RuntimeError):
    """The run was told to stop between two stages or layers."""


@dataclass
class Parsed:
    """What a run has made so far; stage tells how far it came, layers how far within the grammar, and steps how many rows each
    table that it wrote has, counted by the job that wrote it. To go on with a run that ends in an error, start it with a
    Parsed(corpus) of one's own as `resume`, and give that again."""

    corpus: DataFrame
    stage: Stage = Stage.EMPTY
    vocab: DataFrame | None = None
    containment: DataFrame | None = None
    labels: DataFrame | None = None
    graph: DataFrame | None = None
    layers: partition.Layers = field(default_factory=partition.Layers)
    steps: dict[str, int] = field(default_factory=dict)

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        seen = Observation(name)
        table = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.steps[name] = seen.get["rows"]
        return table


def parse_corpus(corpus: DataFrame, until: Stage = Stage.FINISHED, max_n: int | None = None, resume: Parsed | None = None,
                 progress: Callable[[Stage], None] | None = None, cancelled: Callable[[], bool] | None = None) -> Parsed:
    """Runs the stages that `resume` has not run yet. max_n bounds n-grams, which long texts need: labels are then the whole texts
    and what is exact up to that width, and the grammar has one rule a label, its tiling by the longest narrower ones from
    the left, so that every text is spelled. progress is told each stage before it runs; cancelled is asked between stages and
    between the layers of the grammar, which are not made again. Run it by run_tagged(), and stop_tagged() stops its jobs."""
    out = resume or Parsed(non_empty(corpus))

    def check() -> None:
        if cancelled and cancelled():
            raise Cancelled("within a stage")

    def with_roots(found: DataFrame) -> DataFrame:
        """found with the texts that are wider than max_n."""
        if max_n is None:
            return found
        wide = out.corpus.filter(F.length("text") > max_n).select(F.col("text").alias("ngram")).distinct()
        return found.unionByName(wide.select("ngram", F.length("ngram").alias("n"), F.lit("root").alias("kind")))

    def contained() -> None:
        out.vocab = out.settled(containment.vocabulary(out.corpus, max_n), "vocab")
        out.containment = containment.edges(out.vocab)

    def frequent() -> None:
        out.labels = with_roots(labels.base_labels(out.vocab))

    def wrapped() -> None:
        out.labels = out.settled(with_roots(labels.all_labels(out.corpus, out.vocab, max_n)), "labels")

    def partitioned() -> None:
        if max_n is None:
            out.graph, out.labels = partition.partition_graph(out.labels, check, out.layers)
        else:
            roots = settle(out.labels.filter("kind = 'root'").select(F.monotonically_increasing_id().alias("text_id"), F.col("ngram").alias("text")), "roots")
            tops, rules = whole.text_grammar(roots, out.labels)
            named = tops.join(roots.withColumnRenamed("text", "parent"), "text_id").select("parent", "sub_index", "offset", "child", "child_n")
            out.graph = out.settled(named.unionByName(rules).withColumn("pattern_id", F.lit(0)), "graph")

    work = {Stage.CONTAINMENT: contained, Stage.FREQUENCY: frequent, Stage.WRAPPERS: wrapped, Stage.PARTITIONS: partitioned, Stage.FINISHED: lambda: None}
    for stage, run in work.items():
        if cancelled and cancelled():
            raise Cancelled(stage.name)
        if out.stage < stage <= until:
            if progress:
                progress(stage)
            run()
            out.stage = stage  # only now: a run that failed is resumed with this stage
    return out


def run_tagged(spark: SparkSession, tag: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Runs work under a tag, so that stop_tagged(spark, tag) from another thread stops its jobs."""
    spark.sparkContext.addJobTag(tag)  # a session's own tags are known to the thread that set them only
    try:
        return work()
    finally:
        spark.sparkContext.removeJobTag(tag)


def stop_tagged(spark: SparkSession, tag: str) -> None:
    """Stops all jobs that run under a tag now; their callers get Spark's error."""
    spark.sparkContext.cancelJobsWithTag(tag)
