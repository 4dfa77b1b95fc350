"""Shards of a growing table, by size-tiered compaction under versioned manifests.

A store is a folder: data/ holds immutable Parquet shards, manifests/ holds one JSON file per version, which names the parts of its
list of shards; parts/ holds these, with the shards' rows and bytes. A commit writes one part and takes over all those in which
nothing changed, so that it doesn't write anew what a large store has. Arrivals are appended as small shards. Compaction takes shards below the target
size by tiers of like size (powers of `fanout`); a tier of at least `fanout` shards is merged into files of about the target
size, each by one task that streams row groups. A version is committed by creating its manifest, which fails if there is
one already; readers see whole versions only. Files that tasks wrote in vain are in no manifest, and vacuum() removes them.
Commits need a file system that creates or renames exclusively, as local and distributed ones do; not all object stores do.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, ship

TARGET_BYTES, FANOUT, ARRIVALS, ARRIVAL_ROWS = 128 << 20, 4, 8, 4096
_GROUP_ROWS = 1 << 14


class Conflict(Exception):
    """Another writer committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, codec: str = "zstd"):
        if fanout < 2 or target < 1:
            raise ValueError("fanout must be at least 2, target positive")
        self.spark, self.root, self.target, self.fanout, self.codec = spark, root.rstrip("/"), target, fanout, codec
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        ship(spark)

    # manifests

    def _list(self, folder: str) -> list:
        """What is in a folder of the store, by one call."""
        from pyarrow.fs import FileSelector

        files, path = filesystem(f"{self.root}/{folder}")
        return files.get_file_info(FileSelector(path, allow_not_found=True))

    def _json(self, path: str) -> dict:
        files, path = filesystem(f"{self.root}/{path}")
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def _put(self, path: str, what) -> None:
        files, path = filesystem(f"{self.root}/{path}")
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as f:
            f.write(json.dumps(what).encode())

    def versions(self) -> list[int]:
        return sorted(int(i.base_name[1:-5]) for i in self._list("manifests") if i.base_name.endswith(".json") and i.base_name[0] == "v")

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, shards, parts}; shards: [{path, rows, bytes}], parts: the paths of each part's shards. Without any commit,
        version 0 without shards."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": [], "parts": {}}
        m = self._json(f"manifests/v{version:010d}.json")
        with ThreadPoolExecutor(16) as pool:
            lists = dict(zip(m["parts"], pool.map(lambda p: self._json(f"parts/{p}"), m["parts"])))
        return m | {"shards": sorted((s for l in lists.values() for s in l), key=lambda s: s["path"]), "parts": {p: [s["path"] for s in l] for p, l in lists.items()}}

    def _commit(self, base: dict, shards: list[dict], schema) -> dict:
        """The version after base. The manifest is written beside and moved in place only if there is none."""
        live = {s["path"] for s in shards}
        parts = {p: paths for p, paths in base["parts"].items() if live.issuperset(paths)}
        old = {path for paths in parts.values() for path in paths}
        rest = [s for s in shards if s["path"] not in old]
        if rest:
            name = f"{uuid.uuid4().hex}.json"
            self._put(f"parts/{name}", rest)
            parts[name] = [s["path"] for s in rest]
        new = {"version": base["version"] + 1, "schema": schema, "parts": sorted(parts)}
        draft, final = f"{self.root}/manifests/.draft-{uuid.uuid4().hex}", f"{self.root}/manifests/v{new['version']:010d}.json"
        self._put(draft.removeprefix(self.root + "/"), new)
        if final.startswith("file:") or "://" not in final:
            import os

            try:
                os.link(filesystem(draft)[1], filesystem(final)[1])  # atomic, and fails if the version exists
            except FileExistsError:
                raise Conflict(final) from None
            finally:
                os.remove(filesystem(draft)[1])
        elif not self._fs.rename(self._path(draft), self._path(final)):  # distributed file systems refuse an existing target
            self._fs.delete(self._path(draft), False)
            raise Conflict(final)
        return new | {"shards": sorted(shards, key=lambda s: s["path"]), "parts": parts}

    # appends

    def append(self, df: DataFrame) -> dict:
        """One shard for each of df's partitions with rows; a new version. Retries on a concurrent commit."""
        return self._added(self._write(df), df.schema.json())

    def append_stream(self, df: DataFrame, arrivals: int = ARRIVALS, rows: int = ARRIVAL_ROWS) -> dict:
        """df as so many arrivals, a version each, of shards of at most so many rows. They are written in one pass, and full tiers
        are merged as they arrive; what was merged is removed, so no one else may be reading or writing."""
        files, schema = self._write(df, rows), df.schema.json()
        out = self.manifest()
        for k in range(arrivals):
            some = files[k::arrivals]
            if some or not k:
                self._added(some, schema)
                out = self.compact()
                self._forget([f for j in range(k + 1, arrivals) for f in files[j::arrivals]])
        return out

    def _added(self, files: list[dict], schema: str) -> dict:
        while True:
            base = self.manifest()
            if base["schema"] and _names(base["schema"]) != _names(schema):
                raise ValueError("the columns differ from the store's")
            try:
                return self._commit(base, base["shards"] + files, base["schema"] or schema)
            except Conflict:
                continue

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", self.codec).option("maxRecordsPerFile", rows).parquet(folder)
        folder = folder.removeprefix(self.root + "/")
        files = [{"path": f"{folder}/{i.base_name}", "bytes": i.size} for i in self._list(folder) if i.base_name.endswith(".parquet")]
        return sorted(self._counted(files), key=lambda f: f["path"])

    def _counted(self, files: list[dict]) -> list[dict]:
        """With the rows by their footers, read by tasks; empty files drop out."""
        if not files:
            return []
        root = self.root
        plan = self.spark.createDataFrame([(f["path"], f["bytes"]) for f in files], "path string, bytes long").repartition(-(-len(files) // 16))

        def count(batches):
            import pyarrow.parquet as pq

            for b in batches:
                rows = []
                for p in b.column(0).to_pylist():
                    fs, path = filesystem(f"{root}/{p}")
                    with fs.open_input_file(path) as f:
                        rows.append(pq.ParquetFile(f).metadata.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.int64())], ["path", "bytes", "rows"])

        return [r.asDict() for r in plan.mapInArrow(count, "path string, bytes long, rows long").collect() if r.rows]

    # compaction

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards to merge, each into one file of about the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target / 2:
                tiers.setdefault(int(math.log(max(1, s["bytes"]), self.fanout)), []).append(s)
        groups = []
        for tier in sorted(tiers):
            run = sorted(tiers[tier], key=lambda s: (s["bytes"], s["path"]))
            if len(run) < self.fanout:
                continue
            group: list[dict] = []
            for s in run:
                if group and sum(g["bytes"] for g in group) + s["bytes"] > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> dict:
        """Merges tiers until none is full; a version for each round. A lost race is planned anew."""
        while True:
            base = self.manifest()
            groups = self.plan(base["shards"])
            if not groups:
                return base
            made = self._merge(groups)
            gone = {s["path"] for g in groups for s in g}
            while True:
                now = self.manifest()
                if not gone <= {s["path"] for s in now["shards"]}:
                    break  # another compaction took some of them
                try:
                    self._commit(now, [s for s in now["shards"] if s["path"] not in gone] + made, now["schema"])
                    break
                except Conflict:
                    continue

    def _merge(self, groups: list[list[dict]]) -> list[dict]:
        root, codec, folder = self.root, self.codec, f"data/{uuid.uuid4().hex}"
        filesystem(f"{root}/{folder}")[0].create_dir(filesystem(f"{root}/{folder}")[1], recursive=True)
        plan = self.spark.createDataFrame([(i, [s["path"] for s in g]) for i, g in enumerate(groups)], "id long, paths array<string>").repartition(len(groups), F.col("id"))

        def merge(batches):
            import pyarrow.parquet as pq

            for b in batches:
                for group in b.column(1).to_pylist():
                    out = f"{folder}/{uuid.uuid4().hex}.parquet"  # another attempt writes another file
                    fs, path = filesystem(f"{root}/{out}")
                    writer, rows, waiting, held = None, 0, [], 0
                    with fs.open_output_stream(path) as sink:
                        for p in group:
                            with fs.open_input_file(filesystem(f"{root}/{p}")[1]) as f:
                                for batch in pq.ParquetFile(f).iter_batches(_GROUP_ROWS):
                                    if writer is None:
                                        schema = batch.schema.remove_metadata()
                                        writer = pq.ParquetWriter(sink, schema, compression=codec)
                                    waiting.append(batch.cast(schema) if batch.schema != schema else batch)
                                    held, rows = held + batch.nbytes, rows + batch.num_rows
                                    if held > 32 << 20:
                                        writer.write_table(pa.Table.from_batches(waiting, schema))
                                        waiting, held = [], 0
                        if waiting:
                            writer.write_table(pa.Table.from_batches(waiting, schema))
                        writer.close()
                    yield pa.RecordBatch.from_arrays([pa.array([out]), pa.array([fs.get_file_info(path).size], pa.int64()), pa.array([rows], pa.int64())], ["path", "bytes", "rows"])

        return [r.asDict() for r in plan.mapInArrow(merge, "path string, bytes long, rows long").collect()]

    # reads

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store has no version yet")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in m["shards"]])

    def vacuum(self, keep: int = 1) -> None:
        """Removes the data that the last `keep` versions don't have, and the manifests before them. No writer may be at work."""
        self._forget([], keep)

    def _forget(self, coming: list[dict], keep: int = 1) -> None:
        """vacuum(), but for files that are still to be committed."""
        known = self.versions()[-keep:]
        live = {s["path"] for v in known for s in self.manifest(v)["shards"]} | {f["path"] for f in coming}
        for folder in self._list("data"):
            left = 0
            for i in self._list(f"data/{folder.base_name}"):
                if f"data/{folder.base_name}/{i.base_name}" in live:
                    left += 1
                else:
                    filesystem(self.root)[0].delete_file(i.path)
            if not left:
                filesystem(self.root)[0].delete_dir(folder.path)
        for v in self.versions():
            if v not in known:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        named = {p for v in known for p in self._json(f"manifests/v{v:010d}.json")["parts"]}
        for i in self._list("parts"):
            if i.base_name not in named:
                filesystem(self.root)[0].delete_file(i.path)


def _names(schema: str) -> list[tuple[str, str]]:
    return [(f["name"], json.dumps(f["type"])) for f in json.loads(schema)["fields"]]


def sharded(df: DataFrame, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, arrivals: int = ARRIVALS, rows: int = ARRIVAL_ROWS) -> DataFrame:
    """df's rows, all columns as they are, read from a new store at root to which df came in so many arrivals of small shards (of at
    most so many rows), with full tiers merged after each.

    Nulls, empty and very long texts, repeated rows, whatever columns: rows are carried, not looked at. Rows equal or not keep
    no order. An empty table makes a version without shards, which reads as an empty table of the same columns.
    """
    store = Store(df.sparkSession, root, target, fanout)
    store.append_stream(df, arrivals, rows)
    return store.read()
