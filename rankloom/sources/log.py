"""The change log: batches of deletes, upserts and patches by sequence number, and its fold into documents.

A log row is (seq, ord, pos, op, id, attrs): ord is 0 for deletes, 1 for upserts, 2 for patches, whatever order a batch
listed them in; pos is the place within its list; attrs maps names to JSON text, in which null is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir

ORD = {"delete": 0, "upsert": 1, "patch": 2}
LOG_SCHEMA = "seq long, ord int, pos long, op string, id string, attrs map<string,string>"
#: As stored, in folders seq=N: a folder holds one batch or a run of them up to N; `at` is then the batch's own number.
STORED_SCHEMA, STORED_SUMS = LOG_SCHEMA + ", at long", "seq long, crc32 long, at long"
#: Folders that a commit of many batches makes at most; their number must not grow with the batches.
FOLDERS = 32


def foldered(rows: DataFrame, first: int, last: int) -> DataFrame:
    """rows of the batches first to last as they are stored: runs of batches share a folder."""
    run = max(1, -(-(last - first + 1) // FOLDERS))
    end = F.floor((F.col("seq") - first) / run) * run + (first + run - 1)
    return rows.withColumn("at", F.col("seq")).withColumn("seq", F.least(end, F.lit(last)).cast("long"))


def numbered(stored: DataFrame, after: int = 0) -> DataFrame:
    """Stored rows of later batches, by the numbers of these; folders that end before are not read."""
    rows = stored.where(F.col("seq") > after) if after > 0 else stored
    rows = rows.withColumn("seq", F.coalesce("at", "seq")).drop("at")
    return rows.where(F.col("seq") > after) if after > 0 else rows


def ord_of(op: Column) -> Column:
    return F.when(op == "delete", 0).when(op == "upsert", 1).otherwise(2)


def _order() -> Column:
    return F.struct("seq", "ord", "pos")


def live_changes(log: DataFrame) -> DataFrame:
    """The changes that make up today's documents: each id's last upsert, if no delete follows, and its later patches.

    One shuffle, by id; the fold's other steps reuse it.
    """
    resets = F.max(F.when(F.col("op") != "patch", F.struct("seq", "ord", "pos", "op"))).over(Window.partitionBy("id"))
    marked = log.withColumn("_reset", resets)
    return marked.where((F.col("_reset.op") == "upsert") & (_order() >= F.struct("_reset.seq", "_reset.ord", "_reset.pos"))).drop("_reset")


def folded(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(id, attrs, _last_seq): the documents after all batches up to a sequence number.

    A patch merges attribute by attribute, the last one of each wins; one to a document that isn't there is ignored.
    """
    changes = live_changes(log if upto is None else log.where(F.col("seq") <= upto))
    pairs = changes.select("id", "seq", _order().alias("o"), F.explode_outer("attrs").alias("name", "value"))
    latest = pairs.groupBy("id", "name").agg(F.max_by("value", "o").alias("value"), F.max("seq").alias("seq"))
    entries = F.filter(F.collect_list(F.struct("name", "value")), lambda x: x["name"].isNotNull())
    return latest.groupBy("id").agg(F.map_from_entries(entries).alias("attrs"), F.max("seq").alias("_last_seq"))


def replayed(snapshot: DataFrame | None, snapshot_seq: int, log: DataFrame, upto: int) -> DataFrame:
    """State at a sequence number from a snapshot (id, attrs) and the log after it."""
    tail = log.where((F.col("seq") > snapshot_seq) & (F.col("seq") <= upto))
    if snapshot is None:
        return folded(tail)
    start = snapshot.select(F.lit(snapshot_seq).cast("long").alias("seq"), F.lit(1).alias("ord"), F.lit(0).cast("long").alias("pos"), F.lit("upsert").alias("op"), "id", "attrs")
    return folded(start.unionByName(tail.select(*start.columns)))


def touched(log: DataFrame, after: int, upto: int | None = None) -> DataFrame:
    """Ids of all changes after a sequence number, deletes too."""
    tail = log.where(F.col("seq") > after)
    return (tail if upto is None else tail.where(F.col("seq") <= upto)).select("id").distinct()


def eventual(view: DataFrame, cursor: int) -> DataFrame:
    """Documents that the index knows in their last version; one that was written again after the cursor is not shown."""
    return view.where(F.col("_last_seq") <= cursor)


def lag(meta: DataFrame) -> DataFrame:
    """meta (commit_seq, index_cursor) with what is left to index and the status."""
    left = F.col("commit_seq") - F.col("index_cursor")
    return meta.withColumn("lag", left).withColumn("status", F.when(left > 0, "catching_up").otherwise("up_to_date"))


def flush_seq(rows: DataFrame, order: list[str], first: int = 1, batch: int = 512) -> DataFrame:
    """rows with the sequence number of the flush that a group commit of `batch` operations gives them.

    Places are counted without one big sort: rows are ranged, counted by partition and numbered within. The ranged rows
    are cut, as ranging them again might draw other bounds.
    """
    shared_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = ranged.join(F.broadcast(before), "_part").withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    place = F.col("_before") + F.col("_row") - 1
    return numbered.withColumn("seq", (F.floor(place / batch) + first).cast("long")).drop("_part", "_n", "_before", "_row")


def signed(log: DataFrame) -> DataFrame:
    """log with a checksum of each batch."""
    return _sums(log, ["seq"])


def signed_one(batch: DataFrame) -> DataFrame:
    """(crc32) of rows that are one batch, as signed() has it once they are numbered."""
    return _sums(batch, []).select("crc32")


def _sums(log: DataFrame, by: list[str]) -> DataFrame:
    row = F.crc32(F.to_json(F.struct("ord", "pos", "op", "id", F.array_sort(F.map_entries("attrs")).alias("attrs")), {"ignoreNullFields": "false"}).cast("binary"))
    sums = log.groupBy(*by).agg(F.sum(row).alias("_sum"), F.count("*").alias("_n"))
    return sums.select(*by, F.crc32(F.concat_ws(":", F.col("_sum").cast("string"), F.col("_n").cast("string")).cast("binary")).alias("crc32"))


def verified(log: DataFrame, sums: DataFrame, corrupt: str = "fail") -> DataFrame:
    """The log without the batches whose checksum is wrong or missing (corrupt="skip"), or an error for these ("fail")."""
    if corrupt not in ("fail", "skip"):
        raise ValueError("corrupt must be fail or skip")
    good = signed(log).join(sums.withColumnRenamed("crc32", "_want"), "seq", "left").select("seq", F.coalesce(F.col("crc32") == F.col("_want"), F.lit(False)).alias("_ok"))
    if corrupt == "skip":
        return log.join(good.where("_ok"), "seq", "left_semi")
    checked = log.join(good, "seq", "left")
    return checked.where(F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("corrupt log batch "), F.col("seq").cast("string"))).cast("boolean"))).drop("_ok")


def compaction_plan(commit_seq: int, index_cursor: int, snapshot_seq: int, least: int = 10, keep: int = 3) -> tuple[int, int] | None:
    """(snapshot at, delete log up to) once the index has caught up and enough was committed, else nothing."""
    if index_cursor < commit_seq or commit_seq <= least or index_cursor <= snapshot_seq:
        return None
    return index_cursor, index_cursor - keep


def indexing_order(lags: dict[str, int]) -> list[tuple[str, int]]:
    """Namespaces by lag, largest first, and how many batches each may index in its turn."""
    size = lambda n: 1 if n <= 2 else 2 if n <= 8 else 8
    return [(k, size(n)) for k, n in sorted(lags.items(), key=lambda x: (-x[1], x[0])) if n > 0]
