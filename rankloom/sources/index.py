"""A namespace's search index: typed documents, postings and cluster members in segments over the change log.

A segment covers the batches after the one before it: documents, postings and members of the ids that these touched, and
these ids. Rows of a segment count unless a later one, or the log after the last, touched their id. The first segment
fits the cluster centres; later ones assign to them. A manifest names the segments; it is replaced whole, so a reader
sees the old index or the new one. Many segments are merged into one, in which overfull cells are split.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from math import ceil
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import ivf
from . import log as logs
from . import schema as schemas
from .shared import spread

if TYPE_CHECKING:
    from .namespace import Namespace

#: Segments after which they are merged, ids up to which a list is sent to every executor, and tokens in a bucket, about.
MOST_SEGMENTS, SENT_IDS, BUCKET_TOKENS = 8, 500_000, 5_000_000
#: Parts of a bucket by runs of documents, so that no task holds all of a hot term, and terms in a run.
SALT, RUN_TERMS = 8, 2_000_000
#: 2: documents' lengths are postings without a term, in a bucket of their own; there is no table of terms.
FORMAT, LENGTHS = 2, -1
#: Characters of text that a counted term takes, about: buckets are numbered before texts are cut.
TERM_CHARS = 8
#: What each table of a segment holds; given when it is read, as an empty partitioned table has no file to tell.
KINDS = {"touched": "id string", "postings": "term string, id string, tf long, dl int, field string, b int", "members": "id string, v array<double>, fine_id long"}


def _packed(a: np.ndarray) -> dict:
    return {"shape": a.shape, "kind": a.dtype.str, "data": base64.b64encode(np.ascontiguousarray(a).tobytes()).decode()}


def _array(d: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(d["data"]), d["kind"]).reshape(d["shape"]).copy()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, terms) as (term, part, hits): for each term of a run of documents those that hold it, (id, tf, dl), and a
    row without a term with all that have one. A run has up to RUN_TERMS terms, or is one document; runs are spread over
    the parts."""
    for batch in batches:
        lists, ids = batch.column("terms"), batch.column("id")
        lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            upto = max(at + 1, int(np.searchsorted(ends, RUN_TERMS + (ends[at - 1] if at else 0), side="right")))
            dl, words = lengths[at:upto], lists.slice(at, upto - at).flatten().dictionary_encode()
            n, held = upto - at, np.flatnonzero(dl)
            key, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
            term, row = np.divmod(key, n)
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            offsets = np.concatenate([starts, [len(key)], [len(key) + len(held)] if len(held) else []]).astype(np.int32)
            row = np.concatenate([row, held])
            hits = pa.StructArray.from_arrays([ids.slice(at, n).take(pa.array(row)), pa.array(np.concatenate([tf, np.zeros(len(held), np.int64)]), pa.int64()), pa.array(dl[row], pa.int32())], ["id", "tf", "dl"])
            terms = pa.concat_arrays([words.dictionary.take(pa.array(term[starts])), pa.nulls(min(1, len(held)), words.dictionary.type)])
            part = zlib.crc32((ids[at].as_py() or "").encode()) % SALT
            if len(terms):
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), part), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), hits)], ["term", "part", "hits"])
            at = upto


@contextmanager
def writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Tasks may write up to n folders at once, so that rows needn't be sorted by folder before."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SearchIndex:
    def __init__(self, namespace: Namespace, manifest: dict):
        self.ns, self.manifest, self.spark = namespace, manifest, namespace.spark

    def _read(self, segment: str, part: str) -> DataFrame:
        kind, reader = KINDS.get(part.split("/")[0]), self.spark.read
        return (reader.schema(kind) if kind else reader).parquet(self.ns._path(segment, *part.split("/")))

    # ---- making ----

    @staticmethod
    def opened(namespace: Namespace) -> SearchIndex | None:
        """The index that the metadata name, if there is one; one of an older format counts as none, and is made again."""
        where = namespace.meta().get("index")
        manifest = json.loads(namespace.files.read(namespace.name, *where.split("/"))) if where else {}
        return SearchIndex(namespace, manifest) if manifest.get("format") == FORMAT else None

    @staticmethod
    def built(namespace: Namespace, fields: list[str] | None = None, layout: int = 2) -> SearchIndex:
        """An index of all documents as of the last batch; fields: vector fields, all that are there by default."""
        meta = namespace.meta()
        seq = meta["commit_seq"]
        index = SearchIndex(namespace, {"format": FORMAT, "seq": seq, "types": {}, "metric": meta["metric"] or "cosine_distance", "segments": [], "vectors": {}, "text": [], "totals": {}, "buckets": 0, "passes": 0})
        name, typed, types = index._inferred(namespace.documents(seq), meta["schema"])
        index.manifest |= {"types": types, "text": schemas.text_fields(types)}
        for field in [f for f, spec in types.items() if schemas.is_vector(spec) and (fields is None or f in fields)]:
            index._fit(field, typed, layout)
        index._segment(name, seq, typed, None)
        index._saved()
        return index

    def _documents(self, docs: DataFrame, types: dict) -> tuple[str, DataFrame]:
        """Write documents with their typed attributes; the segment's name and these read back."""
        name = f"index/{uuid.uuid4().hex}"
        columns = [schemas.column(spec, F.element_at("attrs", F.lit(n))).alias(f"c_{n}") for n, spec in types.items()]
        docs.select("id", "_last_seq", "attrs", *columns).write.parquet(self.ns._path(name, "documents"))
        return name, self._read(name, "documents")

    def _inferred(self, docs: DataFrame, schema: dict) -> tuple[str, DataFrame, dict]:
        """The same with the types, which are inferred from what is written, so that the log is folded once; documents with
        attributes that nobody declared are written again with these."""
        name, typed = self._documents(docs, schema)
        types = schemas.inferred(typed, schema)
        if types != schema:
            draft = name
            name, typed = self._documents(typed.select("id", "_last_seq", "attrs"), types)
            self.ns.files.delete(self.ns.name, *draft.split("/"))
        return name, typed, types

    def _fit(self, field: str, typed: DataFrame, layout: int) -> None:
        vectors = typed.select("id", F.col(f"`c_{field}`").alias("v"))
        fitted = ivf.fitted(vectors, "id", "v", self.manifest["metric"], layout)
        if fitted is not None:
            self.manifest["vectors"][field] = {"coarse": _packed(fitted.coarse), "fine": _packed(fitted.fine), "parent": _packed(fitted.parent), "layout": layout, "cells": None}

    def centres(self, field: str) -> ivf.Index:
        v = self.manifest["vectors"][field]
        return ivf.Index(_array(v["coarse"]), _array(v["fine"]), _array(v["parent"]), self.manifest["metric"])

    def width(self, field: str) -> int | None:
        v = self.manifest["vectors"].get(field)
        return v["coarse"]["shape"][1] if v else None

    def _segment(self, name: str, seq: int, typed: DataFrame, touched: DataFrame | None) -> None:
        """Write the rest of a segment from its documents and put it into the manifest; touched: ids, if any came before."""
        m, path = self.manifest, lambda *x: self.ns._path(name, *x)
        texts = [f for f in m["text"] if f"c_{f}" in typed.columns]
        gone = 0
        if touched is not None:
            touched.write.parquet(path("touched"))
            gone = self._read(name, "touched").count()
        if texts:
            if not m["buckets"]:
                chars = typed.agg(*[F.sum(F.length(F.col(f"`c_{f}`").cast("string"))) for f in texts]).first()
                m["buckets"] = int(min(4096, max(8, ceil(sum(n or 0 for n in chars) / TERM_CHARS / BUCKET_TOKENS))))
            wide = spread(typed)
            kind = "term string, part int, hits array<struct<id string, tf bigint, dl int>>"
            runs = [wide.select("id", tokens(F.col(f"`c_{f}`").cast("string")).alias("terms")).mapInArrow(counted, kind).withColumn("field", F.lit(f)) for f in texts]
            b = F.when(F.col("term").isNull(), LENGTHS).otherwise(bucket(F.col("term"), m["buckets"]))
            # a number of its own, as adaptive execution would join the parts of few buckets into fewer tasks than cores
            tasks = max(8 * self.spark.sparkContext.defaultParallelism, m["buckets"] * SALT * len(texts))
            parts = _union(runs).withColumn("b", b).repartition(tasks, "field", "b", "part").sortWithinPartitions("term")
            with writers(self.spark, 16):
                parts.select("term", F.inline("hits"), "field", "b").write.partitionBy("field", "b").parquet(path("postings"))
            self._count(self._lengths(name), touched)
        for field in m["vectors"]:
            if f"c_{field}" in typed.columns:
                vectors = typed.select("id", F.col(f"`c_{field}`").alias("v"))
                members = ivf.assigned(self.centres(field), vectors, "id", "v")
                members.repartition(self.spark.sparkContext.defaultParallelism * 4, "fine_id").write.partitionBy("fine_id").parquet(path("members", field))
        m["segments"].append({"name": name, "seq": seq, "touched": gone, "texts": texts, "vectors": [f for f in m["vectors"] if f"c_{f}" in typed.columns]})
        m["seq"] = seq

    def _lengths(self, segment: str) -> DataFrame:
        """(id, field, dl) of a segment's documents with a term."""
        return self._read(segment, "postings").where(F.col("b") == LENGTHS).select("id", "field", "dl")

    def _count(self, terms: DataFrame, touched: DataFrame | None) -> None:
        """Carry on the numbers of documents with a term, and of terms: more by the new ones, fewer by those they replace."""
        change = [terms.select("field", "dl", F.lit(1).alias("sign"))]
        for i, s in enumerate(self.manifest["segments"]):
            if touched is not None and s["texts"]:
                old = self._alive(i, self._lengths(s["name"]))
                change.append(old.join(touched, "id", "left_semi").select("field", "dl", F.lit(-1).alias("sign")))
        totals = self.manifest["totals"]
        for r in _union(change).groupBy("field").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("dl")).collect():
            n, dl = totals.get(r["field"], (0, 0))
            totals[r["field"]] = [n + r["n"], dl + r["dl"]]

    def _saved(self) -> None:
        """Write the manifest under a name of its own, then let the metadata name it."""
        name = f"index/manifest-{uuid.uuid4().hex}.json"
        self.ns.files.create(json.dumps(self.manifest), self.ns.name, *name.split("/"))
        self.ns.changed(lambda meta: meta | {"index": name, "index_cursor": max(meta["index_cursor"], self.manifest["seq"])})

    def parts(self, segment: dict) -> list[tuple[str, list[str]]]:
        """The tables of a segment and what they are partitioned by."""
        out = [("documents", []), *([("touched", [])] if segment["touched"] else [])]
        if segment["texts"]:
            out.append(("postings", ["field", "b"]))
        return out + [(f"members/{f}", ["fine_id"]) for f in segment["vectors"]]

    # ---- following the log ----

    def advanced(self, upto: int | None = None) -> SearchIndex:
        """The index with a segment for the batches up to a number, the last by default; the same again if there are none.

        What is written grows with what the batches touched, not with the documents.
        """
        upto = self.ns.meta()["commit_seq"] if upto is None else upto
        if upto <= self.manifest["seq"]:
            return self
        new = SearchIndex(self.ns, json.loads(json.dumps(self.manifest)))
        m = new.manifest
        touched = logs.touched(self.ns.log(m["seq"]), m["seq"], upto)
        docs = new._tail(touched, upto)
        found = schemas.inferred(docs, self.ns.meta()["schema"])
        m["types"] = schemas.joined(m["types"], found)
        m["text"] = schemas.text_fields(m["types"])
        name, typed = new._documents(docs, {n: m["types"][n] for n in found})
        for field in [f for f, spec in m["types"].items() if schemas.is_vector(spec) and f not in m["vectors"] and f in found]:
            new._fit(field, typed, 2)
        new._segment(name, upto, typed, touched)
        m["passes"] += 1
        if len(m["segments"]) > MOST_SEGMENTS:
            new = new._merged()
        new._saved()
        return new

    def _merged(self) -> SearchIndex:
        """One segment of all rows that count; overfull cells are split, and all centres fitted anew when it is time."""
        seq = self.manifest["seq"]
        out = SearchIndex(self.ns, json.loads(json.dumps(self.manifest)))
        m = out.manifest
        name, typed = out._documents(self.documents(), m["types"])
        for field in list(m["vectors"]):
            old = self.centres(field)
            n = typed.where(F.col(f"`c_{field}`").isNotNull()).count()
            if ivf.needs_rebuild(m["passes"], n, len(old.fine)):
                out._fit(field, typed, m["vectors"][field]["layout"])
            else:
                split = ivf.maintained_cells(old, self.members(field), "id", "v")
                m["vectors"][field] |= {"fine": _packed(split.fine), "parent": _packed(split.parent), "cells": None}
        m |= {"segments": [], "totals": {}, "passes": 0 if m["passes"] >= ivf.REBUILD_PASSES else m["passes"]}
        out._segment(name, seq, typed, None)
        return out

    def measured(self, field: str, k: int = 10) -> int:
        """How many cells keep the recall that approximate search owes, measured once and kept."""
        v = self.manifest["vectors"][field]
        if v["cells"] is None:
            fine = len(_array(v["fine"]))
            if fine <= ivf.PROBE_ALL:
                v["cells"] = fine
            else:
                index = ivf.Index(*ivf.index_arrays(self.centres(field)), self.members(field))
                v["cells"] = ivf.cells_for(index, self.members(field).select("id", "v"), "id", "v", k)
            self._saved()
        return v["cells"]

    # ---- reading ----

    def _later(self, i: int, tail: DataFrame | None) -> list[tuple[DataFrame, int]]:
        out = [(self._read(s["name"], "touched"), s["touched"]) for s in self.manifest["segments"][i + 1 :] if s["touched"]]
        return [*out, (tail, -1)] if tail is not None else out

    def _alive(self, i: int, rows: DataFrame, tail: DataFrame | None = None) -> DataFrame:
        """The rows of a segment whose ids nothing later touched."""
        for ids, n in self._later(i, tail):
            rows = rows.join(F.broadcast(ids) if 0 <= n <= SENT_IDS else ids, "id", "left_anti")
        return rows

    def _table(self, part: str, tail: DataFrame | None, has: str | None = None, field: str | None = None, prune: Any = None) -> DataFrame | None:
        found = []
        for i, s in enumerate(self.manifest["segments"]):
            if has and (field not in s[has]):
                continue
            rows = self._read(s["name"], part)
            found.append(self._alive(i, rows if prune is None else prune(rows), tail))
        return _union(found) if found else None

    def tail(self) -> DataFrame | None:
        """Ids that the log after the index touched; nothing if there is no such log."""
        if self.ns.meta()["commit_seq"] <= self.manifest["seq"]:
            return None
        return logs.touched(self.ns.log(self.manifest["seq"]), self.manifest["seq"])

    def documents(self, tail: DataFrame | None = None) -> DataFrame:
        """(id, attrs, _last_seq) as of the index, without the ids in tail."""
        return self._table("documents", tail, prune=lambda d: d.select("id", "attrs", "_last_seq"))

    def _tail(self, touched: DataFrame, upto: int) -> DataFrame:
        """Documents of touched ids at a later batch, from what the index has of them and the log since."""
        at = self.manifest["seq"]
        start = self.documents().join(touched, "id", "left_semi").select("id", "attrs", "_last_seq") if self.manifest["segments"] else None
        changes = self.ns.log(at).where(F.col("seq") <= upto)
        if start is None:
            return logs.folded(changes)
        base = start.select(F.col("_last_seq").alias("seq"), F.lit(1).alias("ord"), F.lit(0).cast("long").alias("pos"), F.lit("upsert").alias("op"), "id", "attrs")
        return logs.folded(base.unionByName(changes.select(*base.columns)))

    def fresh(self) -> DataFrame | None:
        """(id, attrs, _last_seq) of the live documents among those that the log touched since."""
        touched = self.tail()
        return None if touched is None else self._tail(touched, self.ns.meta()["commit_seq"])

    def types(self, fresh: DataFrame | None) -> dict:
        """Types of all attributes, those of the documents since included."""
        if fresh is None:
            return self.manifest["types"]
        return schemas.joined(self.manifest["types"], schemas.inferred(fresh, self.ns.meta()["schema"]))

    def view(self, types: dict, tail: DataFrame | None, fresh: DataFrame | None) -> DataFrame:
        """Typed documents; stored columns where a segment has them in the type that is asked for."""
        parts = []
        for i, s in enumerate(self.manifest["segments"]):
            rows = self._read(s["name"], "documents")
            want = {n: schemas.column(spec, F.element_at("attrs", F.lit(n))) for n, spec in types.items()}
            kinds = dict(rows.select(*[c.alias(f"c_{n}") for n, c in want.items()]).dtypes) if want else {}
            stored = dict(rows.dtypes)
            own = [(F.col(f"`c_{n}`") if stored.get(f"c_{n}") == kinds[f"c_{n}"] and types[n] == self.manifest["types"].get(n) else c).alias(n) for n, c in want.items()]
            alive = self._alive(i, rows, tail)
            parts.append(alive.select("id", *own, "_last_seq"))
        if fresh is not None:
            parts.append(schemas.typed(fresh, types))
        return _union(parts)

    def postings(self, field: str, terms: list[str], tail: DataFrame | None) -> DataFrame | None:
        """(term, id, tf, dl) of some terms: only their buckets are read."""
        own = [bucket(F.lit(t), self.manifest["buckets"]) for t in terms]
        pick = lambda d: d.where((F.col("field") == field) & (F.col("b").isin(*own) if own else F.lit(False)) & F.col("term").isin(terms)).select("term", "id", "tf", "dl")
        return self._table("postings", tail, "texts", field, pick)

    def statistics(self, field: str, tail: DataFrame | None, fresh_terms: DataFrame | None) -> tuple[int, int]:
        """Documents with a term in the field and terms in all, those since the index included; fresh_terms: (terms)."""
        n, dl = self.manifest["totals"].get(field, (0, 0))
        if tail is None:
            return n, dl
        change = []
        old = self._table("postings", None, "texts", field, lambda d: d.where((F.col("b") == LENGTHS) & (F.col("field") == field)).select("id", "dl"))
        if old is not None:
            change.append(old.join(tail, "id", "left_semi").select(F.lit(-1).alias("sign"), "dl"))
        if fresh_terms is not None:
            change.append(fresh_terms.select(F.lit(1).alias("sign"), F.size("terms").alias("dl")).where("dl > 0"))
        r = _union(change).agg(F.sum("sign"), F.sum(F.col("sign") * F.col("dl"))).first() if change else (0, 0)
        return n + (r[0] or 0), dl + (r[1] or 0)

    def members(self, field: str, cells: list[int] | None = None, tail: DataFrame | None = None) -> DataFrame | None:
        """(id, v, fine_id) of all or some cells; their partitions alone are read."""
        pick = (lambda d: d) if cells is None else (lambda d: d.where(F.col("fine_id").isin(cells)))
        return self._table(f"members/{field}", tail, "vectors", field, lambda d: pick(d).select("id", "v", F.col("fine_id").cast("long").alias("fine_id")))
