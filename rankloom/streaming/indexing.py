"""Incremental indexing of a growing log by Structured Streaming: each micro-batch is a delta that moves the cursor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.log import STORED_SCHEMA, numbered
from ..sources.namespace import Namespace


def changes(spark: SparkSession, log_path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream; a file holds a batch or a run of them."""
    reader = spark.readStream.schema(STORED_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return numbered(reader.parquet(log_path))


def follow(namespace: Namespace, checkpoint: str, apply: Callable[[DataFrame, int], None], files_per_trigger: int | None = None) -> StreamingQuery:
    """Call apply(delta, upto) for what each micro-batch brings and then move the namespace's cursor.

    The files of a micro-batch come in the order of their times, not of their batches. So the delta is read from the log:
    all from the first batch that the micro-batch brings, or from the cursor, up to the last one that any has brought.

    A batch that is run again after a failure gets the same delta, so apply must be idempotent, as replacing the rows of
    touched ids is. The stream ends when the log is used up.
    """
    done = 0

    def step(brought: DataFrame, _: int) -> None:
        nonlocal done
        low, upto = brought.agg(F.min("seq"), F.max("seq")).first()
        if upto is not None:
            done = max(done, upto)
            after = min(low - 1, namespace.meta()["index_cursor"])
            apply(namespace.log(after).where(F.col("seq") <= done), done)
            namespace.indexed_to(done)

    stream = changes(namespace.spark, namespace._path("log"), files_per_trigger)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_search(namespace: Namespace, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep the namespace's search index up with its log: each micro-batch becomes a segment of postings and cluster
    members. A batch that is run again finds itself indexed already."""
    return follow(namespace, checkpoint, lambda delta, upto: namespace.advance_index(upto), files_per_trigger)


class TableIndex:
    """A table keyed by id that follows a namespace: rows of touched ids are replaced from the documents at that point.

    `rows` turns documents (id, attrs, _last_seq) into index rows with an id column; versions are folders, the last complete one counts.
    """

    def __init__(self, namespace: Namespace, path: str, rows: Callable[[DataFrame], DataFrame]):
        self.namespace, self.path, self.rows = namespace, path, rows
        self.version: int | None = None

    def table(self) -> DataFrame | None:
        return None if self.version is None else self.namespace.spark.read.parquet(f"{self.path}/v={self.version}")

    def apply(self, delta: DataFrame, upto: int) -> None:
        ids = delta.select("id").distinct()
        fresh = self.rows(self.namespace.documents(upto).join(ids, "id", "left_semi"))
        old = self.table()
        out = fresh if old is None else old.join(ids, "id", "left_anti").unionByName(fresh)
        out.write.mode("overwrite").parquet(f"{self.path}/v={upto}")
        self.version = upto
