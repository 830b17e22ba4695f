"""Namespaces: a log, snapshots and metadata in a folder, with writes, queries, export, copies and maintenance."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import valid_id, valid_namespace
from ..operators import ivf, writes
from ..plans import indexed
from ..plans import query as plans
from ..plans.spec import parse_query
from . import log as logs
from . import schema as schemas
from .files import Files
from .index import SearchIndex

MOST_ROWS, EXPORT_PAGE, PINNED = 10_000, 10_000, 32
#: Tries of a commit that other writers are in the way of, and versions of the metadata that are kept.
RETRIES, KEPT = 20, 32
FRESH = {"commit_seq": 0, "index_cursor": 0, "snapshot_seq": 0, "first_seq": 1, "schema": {}, "dims": {}, "metric": None, "pending": None, "index": None}


class Catalog:
    """All namespaces below a root; corrupt: what reads of the log do with a batch whose checksum is wrong, "fail" or
    "skip", or None for reads that don't look."""

    def __init__(self, spark: SparkSession, root: str, list_ttl: float = 30.0, corrupt: str | None = None):
        self.spark, self.files, self.ttl, self.corrupt = spark, Files(spark, root), list_ttl, corrupt
        self.pinned: OrderedDict[tuple[str, int], DataFrame] = OrderedDict()
        self._listed: tuple[float, list[str]] | None = None

    def namespace(self, name: str) -> Namespace:
        return Namespace(self, valid_namespace(name))

    def list(self) -> list[str]:
        if not self._listed or time.monotonic() - self._listed[0] > self.ttl:
            self._listed = time.monotonic(), [n for n in self.files.names() if self.files.exists(n, "meta")]
        return list(self._listed[1])

    def drop(self, name: str) -> None:
        if not self.files.exists(valid_namespace(name), "meta"):
            raise KeyError(name)
        self.forget(name)
        self.files.delete(name)
        self._listed = None

    def copy(self, source: str, target: str) -> None:
        """Copy all of a namespace by Spark jobs; later writes to either don't show in the other. A branch is the same."""
        if not self.files.exists(valid_namespace(source), "meta"):
            raise KeyError(source)
        if self.files.exists(valid_namespace(target), "meta"):
            raise ValueError(f"{target} is not empty")
        a, b = self.namespace(source), self.namespace(target)
        meta = a.settled()
        for part in ("log", "sums"):
            a._stored(part).write.partitionBy("seq").parquet(b._path(part))
        if meta["snapshot_seq"]:
            part = f"seq={meta['snapshot_seq']}"
            self.spark.read.parquet(a._path("snapshot", part)).write.parquet(b._path("snapshot", part))
        index = SearchIndex.opened(a)
        for s in index.manifest["segments"] if index else []:
            for part, by in index.parts(s):
                index._read(s["name"], part).write.partitionBy(*by).parquet(b._path(s["name"], *part.split("/")))
        if index:
            self.files.create(json.dumps(index.manifest), target, *meta["index"].split("/"))
        if not self.files.create(json.dumps(meta, sort_keys=True), target, "meta", _version(1)):
            raise ValueError(f"{target} is not empty")
        self._listed = None

    def forget(self, name: str) -> None:
        for key in [k for k in self.pinned if k[0] == name]:
            self.pinned.pop(key).unpersist()


class Conflict(RuntimeError):
    """Another writer was first."""


def _version(n: int) -> str:
    return f"{n:012d}.json"


def _columns(columns: dict) -> list[dict]:
    ids = columns.get("id")
    if not isinstance(ids, list):
        raise ValueError("columns need a list of ids")
    if any(not isinstance(v, list) or len(v) != len(ids) for v in columns.values()):
        raise ValueError("columns must be as long as the ids")
    return [{k: v[i] for k, v in columns.items()} for i in range(len(ids))]


class Namespace:
    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.spark, self.files = catalog, name, catalog.spark, catalog.files

    def _path(self, *parts: str) -> str:
        return "/".join([self.files.root, self.name, *parts])

    def versions(self) -> list[str]:
        return [n for n in self.files.names(self.name, "meta") if not n.startswith(".")]

    def versioned(self) -> tuple[int, dict]:
        """The metadata and their version; 0 for a namespace that isn't there."""
        for _ in range(5):
            names = self.versions()
            if not names:
                return 0, dict(FRESH)
            try:
                return int(names[-1].split(".")[0]), FRESH | json.loads(self.files.read(self.name, "meta", names[-1]))
            except Exception:  # the version was superseded and cleared away meanwhile
                if names[-1] in self.versions():
                    raise
        raise Conflict(self.name)

    def meta(self) -> dict:
        version, meta = self.versioned()
        if not version:
            raise KeyError(self.name)
        return meta

    def _replace(self, version: int, meta: dict) -> bool:
        """The metadata of the next version, if no other writer has made it."""
        done = self.files.create(json.dumps(meta, sort_keys=True), self.name, "meta", _version(version + 1))
        if done and version > KEPT and version % KEPT == 0:
            for n in self.versions()[:-KEPT]:
                self.files.delete(self.name, "meta", n)
        return done

    def changed(self, change: Callable[[dict], dict]) -> dict:
        """Change the metadata; tried again on what another writer left until it holds."""
        for attempt in range(RETRIES):
            version, meta = self.versioned()
            new = change(meta)
            if new == meta or self._replace(version, new):
                return new
            time.sleep(random.random() * 0.05 * (attempt + 1))
        raise Conflict(f"{self.name}: {RETRIES} tries lost to other writers")

    def settled(self) -> dict:
        """The metadata, once the rows of the last commit are where reads look for them."""
        meta = self.meta()
        for part in ("log", "sums") if meta["pending"] else ():
            aside = self.name, part, f"_{meta['pending']}"
            batches = [n for n in self.files.names(*aside) if n.startswith("seq=")]
            for n in batches:
                self.files.move((*aside, n), (self.name, part, n))
            if self.files.exists(*aside) and all(self.files.exists(self.name, part, n) for n in batches):
                self.files.delete(*aside)
        return meta

    def _commit(self, rows: DataFrame, seq: int | None = None, expected: int | None = None, change: dict | None = None, last: int | None = None) -> int:
        """Commit rows (ord, pos, op, id, attrs) as the next batch, or as batches `seq` to `last` where they have their
        numbers already.

        The rows are written aside; the next version of the metadata, which only one writer can make, numbers and names
        them, and then they are moved to their place, by whoever comes first should this writer be lost. `expected`: the
        version that must still be the last one.
        """
        name = uuid.uuid4().hex
        for attempt in range(RETRIES):
            version, meta = self.versioned()
            if expected is not None and version != expected:
                raise Conflict(self.name)
            if version:
                self.settled()
            first = meta["commit_seq"] + 1
            if seq is not None and seq < first:
                raise ValueError(f"batches up to {meta['commit_seq']} are committed")
            if attempt == 0:
                kept = rows.withColumn("seq", F.lit(0).cast("long")) if seq is None else logs.foldered(rows, seq, last).repartitionByRange("at")
                kept.write.partitionBy("seq").parquet(self._path("log", f"_{name}"))
                sums = logs.signed(logs.numbered(self.spark.read.schema(logs.STORED_SCHEMA).parquet(self._path("log", f"_{name}"))))
                (sums if seq is None else logs.foldered(sums, seq, last)).repartition(1).write.partitionBy("seq").parquet(self._path("sums", f"_{name}"))
            if seq is None:
                for part in ("log", "sums"):
                    for n in [x for x in self.files.names(self.name, part, f"_{name}") if x.startswith("seq=") and x != f"seq={first}"]:
                        self.files.move((self.name, part, f"_{name}", n), (self.name, part, f"_{name}", f"seq={first}"))
            upto = first if seq is None else last
            if self._replace(version, meta | (change or {}) | {"commit_seq": upto, "pending": name}):
                self.settled()
                return upto
            time.sleep(random.random() * 0.05 * (attempt + 1))
        raise Conflict(f"{self.name}: {RETRIES} tries lost to other writers")

    def folders(self, part: str = "log") -> list[int]:
        """The last batches of the log's folders, in order."""
        return sorted(int(n[4:]) for n in self.files.names(self.name, part) if n.startswith("seq="))

    def _stored(self, part: str) -> DataFrame:
        kind = logs.STORED_SCHEMA if part == "log" else logs.STORED_SUMS
        return self.spark.read.schema(kind).parquet(self._path(part)) if self.files.exists(self.name, part) else self.spark.createDataFrame([], kind)

    def log(self, after: int = 0, corrupt: str | None = None) -> DataFrame:
        """The log's rows of later batches; folders are partitions, so earlier ones are not read. corrupt: "fail" or "skip"
        has the checksums looked at; as the catalog says by default."""
        rows = logs.numbered(self._stored("log"), after)
        corrupt = corrupt or self.catalog.corrupt
        return logs.verified(rows, logs.numbered(self._stored("sums"), after), corrupt).select(*rows.columns) if corrupt else rows

    def documents(self, upto: int | None = None) -> DataFrame:
        """(id, attrs, _last_seq) at a sequence number, the last by default."""
        meta = self.settled()
        upto = meta["commit_seq"] if upto is None else upto
        snap = meta["snapshot_seq"]
        if snap and snap <= upto:
            start = self.spark.read.parquet(self._path("snapshot", f"seq={snap}"))
            return logs.replayed(start, snap, self.log(snap), upto)
        if upto < meta["first_seq"] - 1:
            raise ValueError(f"the log before {meta['first_seq']} is compacted")
        return logs.folded(self.log(), upto)

    def index(self) -> SearchIndex | None:
        return SearchIndex.opened(self)

    def view(self, consistency: str = "strong") -> DataFrame:
        """id, one column for each attribute, and _last_seq; of an index's documents and the log since, where there is one."""
        meta = self.settled()
        pinned = self.catalog.pinned.get((self.name, meta["commit_seq"]))
        index = self.index() if pinned is None else None
        if index and index.manifest["segments"] and not (consistency == "eventual" and index.manifest["seq"] != meta["index_cursor"]):
            tail = index.tail()
            fresh = None if tail is None or consistency == "eventual" else index.fresh()
            return index.view(index.types(fresh), tail, fresh)
        docs = pinned if pinned is not None else self.documents()
        if consistency == "eventual":
            docs = logs.eventual(docs, meta["index_cursor"])
        return schemas.typed(docs, schemas.inferred(docs, meta["schema"]))

    def warm(self) -> None:
        """Keep the current documents in memory; the least recently warmed go beyond a limit."""
        key = self.name, self.meta()["commit_seq"]
        pinned = self.catalog.pinned
        if key not in pinned:
            self.catalog.forget(self.name)
            pinned[key] = self.documents().persist()
        pinned.move_to_end(key)
        while len(pinned) > PINNED:
            pinned.popitem(last=False)[1].unpersist()

    def append(self, changes: DataFrame) -> int:
        """Commit a DataFrame (op, id, attrs, pos) as one batch; any size, no rows pass the driver."""
        return self._commit(_ordered(changes))

    def affected(self, seq: int) -> DataFrame:
        """(id, what) of the upserts and deletes of a batch, however many; what: "upserted" or "deleted"."""
        rows = self.log(seq - 1).where((F.col("seq") == seq) & F.col("op").isin("upsert", "delete"))
        return rows.select("id", F.when(F.col("op") == "upsert", "upserted").otherwise("deleted").alias("what")).distinct()

    def append_batches(self, log: DataFrame) -> int:
        """Commit a whole log whose batches are numbered onwards from the last one; runs of them share
        a folder where they are many."""
        first, last = log.agg(F.min("seq"), F.max("seq")).first()
        if first is None:
            return self.versioned()[1]["commit_seq"]
        return self._commit(log.select("ord", "pos", "op", "id", "attrs", "seq"), first, last=last)

    def write(self, request: dict) -> dict:
        """One write: deletes, then upserts, then patches, whatever their order here; filters and conditions are judged by
        the state before it, again if another writer was first. Returns what was affected."""
        for attempt in range(RETRIES):
            try:
                return self._written(request)
            except Conflict:
                time.sleep(random.random() * 0.05 * (attempt + 1))
        raise Conflict(f"{self.name}: {RETRIES} tries lost to other writers")

    def _written(self, request: dict) -> dict:
        if request.get("copy_from_namespace") or request.get("branch_from_namespace"):
            if len(request) > 1:
                raise ValueError("a copy can't be combined with other writes")
            source = request.get("copy_from_namespace") or request["branch_from_namespace"]
            self.catalog.copy(source, self.name)
            return {"rows_affected": 0}
        version, meta = self.versioned()
        known = version > 0
        schema = schemas.merged(meta["schema"], request.get("schema") or {})
        metric = request.get("distance_metric")
        if metric and meta["metric"] and metric != meta["metric"]:
            raise ValueError("the distance metric can't change")
        if metric and metric not in plans.vectors.METRICS:
            raise ValueError(f"unknown distance metric: {metric}")
        upserts = [*(request.get("upsert_rows") or []), *_columns(request.get("upsert_columns") or {"id": []})]
        patches = [*(request.get("patch_rows") or []), *_columns(request.get("patch_columns") or {"id": []})]
        deletes = list(request.get("deletes") or [])
        if len(upserts) + len(patches) + len(deletes) > MOST_ROWS:
            raise ValueError(f"{MOST_ROWS} rows a write at most")
        out: dict[str, Any] = {}
        for row in (*upserts, *patches):
            valid_id(row.get("id"))
        for d in deletes:
            valid_id(d)
        vector_names = {k for k, v in schema.items() if schemas.is_vector(v)}
        for row in patches:
            if vector_names & row.keys():
                raise ValueError("vectors can't be patched")
        current = self.view() if known and any(request.get(k) for k in ("delete_by_filter", "patch_by_filter", "upsert_condition", "patch_condition", "delete_condition")) else None
        partial = bool(request.get("allow_partial"))
        if request.get("delete_by_filter") and current is not None:
            ids, left = writes.resolved(current, request["delete_by_filter"], partial=partial)
            deletes += [r[0] for r in ids.collect()]
            out["rows_remaining"] = left
        if request.get("patch_by_filter") and current is not None:
            ask = request["patch_by_filter"]
            if vector_names & ask["patch"].keys():
                raise ValueError("vectors can't be patched")
            ids, left = writes.resolved(current, ask["filters"], partial=partial)
            own = {row["id"]: row for row in patches}
            for r in ids.collect():
                if r[0] in own:
                    own[r[0]].update({k: v for k, v in ask["patch"].items() if k not in own[r[0]]})
                else:
                    patches.append({"id": r[0], **ask["patch"]})
            out["rows_remaining"] = out.get("rows_remaining", 0) + left
        stored = lambda row: {k: schemas.to_json(schemas.canonical(k, v, schema.get(k))) for k, v in row.items() if k != "id"}
        ups = [(r["id"], stored(r)) for r in upserts]
        pats = [(r["id"], stored(r)) for r in patches]
        judged = {"upsert": ups, "patch": pats, "delete": [(d, {}) for d in deletes]}
        dims = dict(meta["dims"])
        for row in upserts:
            for k, v in row.items():
                if k != "id" and (schemas.is_vector(schema[k]) if k in schema else isinstance(v, list)) and isinstance(v, list) and v and isinstance(v[0], (int, float)):
                    dims.setdefault(k, len(v))
        for kind, rows in judged.items():
            when = request.get(f"{kind}_condition")
            if when is None or not rows:
                continue
            if current is None:
                judged[kind] = rows if kind == "upsert" else []
                continue
            raw = self.spark.createDataFrame([(i, a) for i, a in rows], "id string, attrs map<string,string>")
            types = schemas.inferred(raw, schema)
            incoming = schemas.typed(raw, types)
            passed = {r[0] for r in writes.applied(kind, current.drop("_last_seq"), incoming, when).select("id").collect()}
            judged[kind] = [r for r in rows if r[0] in passed]
        changes = [(op, i, a, n) for op in ("delete", "upsert", "patch") for n, (i, a) in enumerate(judged[op])]
        change = {"schema": schema, "dims": dims, "metric": meta["metric"] or metric or plans.vectors.METRICS[0]}
        if changes:
            rows = [(op, i, a if op != "delete" else None, n) for op, i, a, n in changes]
            batch = self.spark.createDataFrame(rows, "op string, id string, attrs map<string,string>, pos long").coalesce(1)
            seq = self._commit(_ordered(batch), expected=version, change=change)
            if request.get("block_until_indexed"):
                self.wait_until_indexed(seq)
        elif any(meta[k] != v for k, v in change.items()) and not self._replace(version, meta | change):
            raise Conflict(self.name)
        if request.get("return_affected_ids"):
            out |= {"upserted_ids": [r[0] for r in judged["upsert"]], "deleted_ids": [r[0] for r in judged["delete"]]}
        counts = {f"rows_{k}": len(v) for k, v in (("upserted", judged["upsert"]), ("patched", judged["patch"]), ("deleted", judged["delete"]))}
        return out | counts | {"rows_affected": len(changes)}

    def query(self, request: dict, **how) -> DataFrame:
        """The result of a query as a DataFrame (id, dist, attributes): through the index where it serves all that the
        query ranks by, else by a scan. how: plans.query.Settings. Small jobs find statistics and cut fusions before."""
        parsed = parse_query(request)
        meta = self.meta()
        settings = replace(plans.Settings(metric=meta["metric"] or plans.vectors.METRICS[0]), **how)
        index = None if settings.scan else self.index()
        if index is not None and indexed.served(index, parsed, settings) and not (parsed.consistency == "eventual" and index.manifest["seq"] != meta["index_cursor"]):
            return indexed.compiled(index, parsed, settings)
        view = self.view(parsed.consistency).drop("_last_seq")
        plans.check_dimensions(view, parsed, {f: self.dimensions(f, meta) for f in view.columns})
        return plans.compiled(view, parsed, settings)

    def dimensions(self, field: str, meta: dict | None = None) -> int | None:
        """Of a vector field: as declared, or as in the first row that was written."""
        meta = meta or self.meta()
        return schemas.declared_width(meta["schema"].get(field)) or meta["dims"].get(field)

    def explain(self, request: dict) -> str:
        df = self.query(request)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def statistics(self, request: dict) -> dict:
        """Candidates, their part of all documents and the bytes a query is billed for; costs a job of its own."""
        from ..operators.measures import billed

        parsed = parse_query(request)
        view = self.view(parsed.consistency).drop("_last_seq")
        n = plans.scored(view, parsed, plans.Settings(metric=self.meta()["metric"] or plans.vectors.METRICS[0])).count()
        row = billed(view, n).first()
        return {"candidates": n, "candidates_ratio": n / max(1, row["docs"]), "exhaustive_count": row["docs"], "billable_logical_bytes_queried": row["queried_bytes"]}

    def export(self, last_id: str | None = None, limit: int = EXPORT_PAGE) -> tuple[DataFrame, str | None]:
        """A page of documents by id and where the next one starts, if this one is full."""
        return export_page(schemas.typed(self.documents(), schemas.inferred(self.documents(), self.meta()["schema"])).drop("_last_seq"), last_id, limit)

    def export_all(self, page: int = EXPORT_PAGE) -> Iterator[DataFrame]:
        last = None
        while True:
            df, last = self.export(last, page)
            yield df
            if last is None:
                return

    def metadata(self) -> dict:
        meta = self.meta()
        tail = sum(self.files.length(self.name, "log", f"seq={s}") for s in self.folders() if s > meta["index_cursor"])
        return {"approx_row_count": self.documents().count(), "unindexed_bytes": tail, "index_lag": meta["commit_seq"] - meta["index_cursor"], "status": "catching_up" if meta["index_cursor"] < meta["commit_seq"] else "up_to_date", **{k: meta[k] for k in ("commit_seq", "index_cursor", "snapshot_seq", "schema", "metric")}}

    def indexed_to(self, seq: int) -> None:
        self.changed(lambda meta: meta | {"index_cursor": max(meta["index_cursor"], min(seq, meta["commit_seq"]))})

    def compact(self) -> bool:
        """Write a snapshot at the cursor and drop the log well before it, once the index has caught up."""
        meta = self.settled()
        todo = logs.compaction_plan(meta["commit_seq"], meta["index_cursor"], meta["snapshot_seq"])
        if not todo:
            return False
        at, upto = todo
        self.documents(at).select("id", "attrs").write.mode("overwrite").parquet(self._path("snapshot", f"seq={at}"))
        self.changed(lambda m: m | {"snapshot_seq": at, "first_seq": upto + 1})
        for part in ("log", "sums"):
            for s in [s for s in self.folders(part) if s <= upto]:
                self.files.delete(self.name, part, f"seq={s}")
        return True

    def build_index(self, fields: list[str] | None = None, layout: int = 2) -> SearchIndex:
        """An index of all documents, which queries use from then on; fields: vector fields, all by default."""
        return SearchIndex.built(self, fields, layout)

    def advance_index(self, upto: int | None = None) -> SearchIndex:
        """The index up to a batch, the last by default: a segment more, or the first one."""
        index = self.index()
        return self.build_index() if index is None else index.advanced(upto)

    def wait_until_indexed(self, seq: int | None = None, timeout: float = 30.0) -> None:
        """Return once the index has a batch. An index of the namespace's own is moved on here; without one, whoever
        follows the log has to come up to it in time."""
        seq = self.meta()["commit_seq"] if seq is None else seq
        if self.index() is not None:
            self.advance_index()
        until = time.monotonic() + timeout
        while self.meta()["index_cursor"] < seq:
            if time.monotonic() > until:
                raise TimeoutError(f"the index of {self.name} is not at {seq} after {timeout} seconds")
            time.sleep(0.05)

    def vacuum(self) -> int:
        """Delete what the current index doesn't name; how many folders and files went. Not while others query or write."""
        index, meta = self.index(), self.meta()
        keep = {s["name"].split("/")[1] for s in index.manifest["segments"]} | {meta["index"].split("/")[1]} if index else set()
        gone = [n for n in self.files.names(self.name, "index") if n not in keep]
        for n in gone:
            self.files.delete(self.name, "index", n)
        return len(gone)

    def recall(self, field: str, num: int = 25, top_k: int = 10, filters: Any = None, index: ivf.Index | None = None) -> dict[str, float]:
        view = self.view().drop("_last_seq")
        if index is None:
            own = self.index() or self.build_index()
            index = ivf.Index(*ivf.index_arrays(own.centres(field)), own.members(field).withColumnRenamed("v", field)) if field in own.manifest["vectors"] else None
        if index is None:
            return {"avg_recall": 0.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}
        if filters is not None:
            from ..plans.predicates import Scope, condition
            from ..plans.spec import parse_filter

            view = view.where(condition(Scope(view.schema), parse_filter(filters)))
        return ivf.recall(index, view.select("id", field), "id", field, self.name, num, top_k)


def _ordered(changes: DataFrame) -> DataFrame:
    return changes.select(logs.ord_of(F.col("op")).alias("ord"), F.col("pos").cast("long").alias("pos"), "op", "id", "attrs")


def export_page(docs: DataFrame, last_id: Any, limit: int, id_col: str = "id") -> tuple[DataFrame, Any]:
    """Rows with greater ids in order, `limit` within 1 and 10000, and the last id if the page is full."""
    n = min(EXPORT_PAGE, max(1, limit))
    page = page_rows(docs, last_id, n, id_col)
    ids = [r[0] for r in page.select(id_col).collect()]
    return page, ids[-1] if len(ids) == n else None


def page_rows(docs: DataFrame, last_id: Any, limit: int, id_col: str = "id") -> DataFrame:
    rest = docs if last_id is None else docs.where(F.col(id_col) > F.lit(last_id))
    return rest.orderBy(id_col).limit(min(EXPORT_PAGE, max(1, limit)))


def ndjson(rows: DataFrame) -> DataFrame:
    """(line): each row as a JSON object, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


def expanded(columns: DataFrame) -> DataFrame:
    """Rows of a frame whose single row holds equally long arrays; other lengths are an error."""
    names = columns.columns
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(F.col(n)) == F.size(F.col(names[0])))
    checked = columns.withColumn("_ok", F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("columns must be as long as the ids")).cast("boolean"))).where("_ok")
    return checked.select(F.inline(F.arrays_zip(*[F.col(n) for n in names])))
