"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of `shards` sums. Differencing takes the two of the largest spread and adds them in
opposite orders, until one is left. Groups are ranged by descending bytes into blocks of about `block`; each block is
differenced together with the partial partition that the blocks before left, so that the many small groups level what
the heavy ones leave. That takes one small task a block, in turn, which returns only the partition; a second, parallel pass
assigns the groups. No task holds more than a block, and the driver only a partition a block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 20_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the partition that differencing the rows leaves, descending, and for each row the slot of each of its entries.

    Rows are partial partitions; those of equal spread go in the order they are given.
    """
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, axis=1)
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    store: list[np.ndarray | None] = list(sums)
    # what a merged node is made of: its left child's slots, then its right child's reversed, both put in sorted order
    left, right, moved = [], [], []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = store[a] + store[b][::-1]
        store[a] = store[b] = None
        by = np.argsort(-total, kind="stable")
        left.append(a)
        right.append(b)
        moved.append(by)
        store.append(total[by])
        heapq.heappush(heap, (-int(store[-1][0] - store[-1][-1]), len(store) - 1))
    slots: list[np.ndarray | None] = [None] * len(store)
    slots[-1] = np.arange(k)
    for m in range(len(left) - 1, -1, -1):
        at = np.empty(k, np.int64)
        at[moved[m]] = slots[n + m]
        slots[left[m]] = at
        slots[right[m]] = at[::-1]
        slots[n + m] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, order[i]] = slots[i]
    return store[-1], out


def _carried(rows: pd.DataFrame, shards: int, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each shard once the block's rows (node, bytes) join those in carry, and the shard of each row."""
    parts = np.zeros((len(rows) + 1, shards), np.int64)
    parts[0] = carry
    parts[1:, 0] = rows["bytes"]
    total, slots = difference(parts)
    # the entries of carry keep their shards, whatever slots they move to
    shard = np.argsort(slots[0])
    after = np.empty(shards, np.int64)
    after[shard] = total
    return after, shard[slots[1:, 0]]


def _block(batches) -> pd.DataFrame | None:
    """The rows of a partition, heaviest first."""
    found = [pdf for pdf in batches if len(pdf)]
    return pd.concat(found).sort_values(["bytes", "node"], ascending=[False, True], ignore_index=True) if found else None


def _carries(groups: DataFrame, blocks: int, shards: int) -> list[list[int]]:
    """The partial partition that each block starts from."""
    sc = groups.sparkSession.sparkContext
    out = [[0] * shards]
    for i in range(blocks - 1):
        carry = out[-1]

        def run(batches, carry=carry):
            rows = _block(batches)
            if rows is not None:
                yield pd.DataFrame({"sums": [_carried(rows, shards, np.array(carry, np.int64))[0]]})

        # only this block's partition is read
        left = sc.runJob(groups.mapInPandas(run, "sums array<long>").rdd, list, [i])
        out.append([int(x) for x in left[0]["sums"]] if left else carry)
    return out


def sharded(docs: DataFrame, group: list, shards: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, group_key, shard): rows of one group share a shard, and shards hold about equally many bytes of text.

    group: columns or expressions whose values together name the group; nulls are a value like any other. Null texts
    have no bytes; null ids and repeated rows are rows like others, a very long text is as heavy as it is. Groups of equal
    bytes go in the order of their keys, partitions of equal spread in the order they arose. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.sha2(F.to_json(F.struct(*[F.expr(g).alias(f"g{i}") if isinstance(g, str) else g.alias(f"g{i}") for i, g in enumerate(group)]), {"ignoreNullFields": "false"}), 256)
    rows = cut(docs.select(key.alias("group_key"), docs[id_col].try_cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("bytes")))
    groups = cut(rows.groupBy("group_key").agg(F.sum("bytes").alias("bytes")).withColumnRenamed("group_key", "node"))
    n = groups.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, group_key string, shard long")
    blocks = -(-n // block)
    groups = cut(groups.repartitionByRange(blocks, F.desc("bytes"), "node"))
    blocks = groups.rdd.getNumPartitions()
    sent = spark.sparkContext.broadcast(_carries(groups, blocks, shards))

    def run(batches):
        rows = _block(batches)
        if rows is not None:
            carry = np.array(sent.value[TaskContext.get().partitionId()], np.int64)
            yield pd.DataFrame({"group_key": rows["node"], "shard": _carried(rows, shards, carry)[1]})

    assigned = cut(groups.mapInPandas(run, "group_key string, shard long"))
    return rows.join(assigned, "group_key").select("doc_id", "group_key", "shard")
