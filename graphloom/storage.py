"""Shared-folder staging and the graph store: versioned Parquet tables behind a pointer file.

SURVEY rows 21-28, 34-37, 394: open, insert, purge, metadata, snapshots.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schema


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of an iteration: written once to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, size: int = 1 << 21) -> int:
    """Tasks for a shuffle of rows that Spark takes for so many bytes, by the files they come from."""
    return max(1, min(4096, df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // size))


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(ddl))


class GraphStore:
    """Tables of one graph. A version is a folder with its own tables and a manifest that names the folder of each table,
    so that unchanged tables are shared; root/CURRENT names the version that readers see, and is replaced in one step.

    A missing table reads as an empty one of its declared schema.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        path, fs = self._path(f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        return "\n".join(r.value for r in self.spark.read.text(str(path)).collect())

    def _write_text(self, name: str, text: str) -> None:
        context = self.spark.sparkContext
        jvm = context._jvm
        path, fs = self._path(f"{self.root}/{name}.tmp")
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._path(f"{self.root}/{name}")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = context._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path).toUri(), context._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(path), fs.makeQualified(target), options)

    def version(self) -> str | None:
        return self._read_text("CURRENT")

    def manifest(self) -> dict:
        """{tables: {table: folder}, state: {...}} of the current version."""
        version = self.version()
        return json.loads(self._read_text(f"{version}/MANIFEST.json") or "{}") if version else {}

    def state(self) -> dict:
        """What was written with the current version, and became visible with it."""
        return self.manifest().get("state", {})

    def read(self, table: str) -> DataFrame:
        folder = self.manifest().get("tables", {}).get(table)
        return self.spark.read.parquet(f"{self.root}/{folder}/{table}") if folder else empty(self.spark, schema.TABLES[table])

    def write(self, tables: dict[str, DataFrame], version: str | None = None, state: dict | None = None) -> str:
        """Write a new version, in which tables not given are those of the one before, then move the pointer."""
        version = version or f"v-{uuid.uuid4().hex[:12]}"
        folders = dict(self.manifest().get("tables", {}))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
            folders[name] = version
        self._write_text(f"{version}/MANIFEST.json", json.dumps({"tables": folders, "state": state or {}}, sort_keys=True))
        self._write_text("CURRENT", version)
        return version

    def meta(self) -> dict:
        return json.loads(self._read_text("META.json") or "{}")

    def set_meta(self, **entries) -> None:
        self._write_text("META.json", json.dumps(self.meta() | entries, sort_keys=True))

    def snapshot_save(self, name: str) -> None:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad snapshot name {name!r}")
        self.set_meta(snapshots=self.meta().get("snapshots", {}) | {name: self.version()})

    def snapshot_restore(self, name: str) -> None:
        self._write_text("CURRENT", self.meta()["snapshots"][name])

    def snapshot_list(self) -> list[str]:
        return sorted(self.meta().get("snapshots", {}))

    def snapshot_delete(self, name: str) -> None:
        kept = dict(self.meta().get("snapshots", {}))
        del kept[name]
        self.set_meta(snapshots=kept)


def insert_nodes(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Row 23: rows whose (name, kind, file, line) is new are added."""
    return existing.unionByName(rows.dropDuplicates(["name", "kind", "file", "line"]).join(existing.select("name", "kind", "file", "line"), ["name", "kind", "file", "line"], "left_anti").select(existing.columns))


def insert_edges(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows 24, 157: edges are unique over all seven columns, nulls included."""
    return existing.unionByName(rows).dropDuplicates(["source_id", "target_id", "kind", "confidence", "dynamic", "technique", "dynamic_kind"])


def purge_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows 27-28: nodes of the files go, and all edges at them."""
    gone = nodes.join(files, "file", "left_semi").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(files, "file", "left_anti"), kept.select(edges.columns)


def config_hash(config: dict) -> str:
    """Row 415: changes of it force a full build."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def node_id(*columns: str):
    return F.xxhash64(*columns)
