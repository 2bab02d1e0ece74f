"""Tables of documents on shared storage, written in committed batches and read as of the latest one.

Layout below ``path``: ``<table>/batch_id=<n>/`` holds what a batch wrote, ``_commits/batch_<n>/`` the manifest of that batch, one JSON
row per table. The manifest is written last, so a batch counts as a whole or not at all: a writer that dies leaves
a folder that no manifest names, and the batch that runs again overwrites it. A batch whose manifest exists is skipped when it is
replayed. The version of a document is the latest batch that names it in the table ``heads``; its rows of all tables come
from that batch alone. ``compact`` folds all batches into a base, so the number of folders stays bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEADS = "heads"
MANIFEST = "batch_id bigint, table string, base boolean, schema string"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


class DocumentStore:
    """One writer, any number of readers. ``key`` names the document in every table."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _folder(self, table: str, batch_id: int, base: bool = False) -> str:
        return f"{self.path}/{table}/{'base/' if base else ''}batch_id={batch_id}"

    def _manifests(self) -> list:
        if not path_exists(self.spark, f"{self.path}/_commits"):
            return []
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/_commits/*").collect()  # one row per batch and table

    def manifest(self) -> list:
        """The live rows: of the latest base and the batches behind it. Compaction bounds their number."""
        rows = self._manifests()
        base = max((r["batch_id"] for r in rows if r["base"]), default=-1)
        live = [r for r in rows if r["batch_id"] > base or (r["base"] and r["batch_id"] == base)]
        return sorted(live, key=lambda r: (r["batch_id"], r["table"]))

    def batches(self) -> list[int]:
        return sorted({r["batch_id"] for r in self.manifest()})

    def version(self) -> int | None:
        """The last committed batch."""
        return max(self.batches(), default=None)

    def is_committed(self, batch_id: int) -> bool:
        """Also true for batches that were compacted since: batches are committed in order."""
        last = self.version()
        return last is not None and batch_id <= last

    def stage(self, batch_id: int, table: str, rows: DataFrame) -> DataFrame:
        """Write a table of a batch and read it back; nobody sees it before the batch is committed."""
        folder = self._folder(table, batch_id)
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def commit(self, batch_id: int, tables: dict[str, DataFrame], base: bool = False) -> None:
        """Make the staged ``tables`` of a batch visible together; ``heads`` must be one of them."""
        if HEADS not in tables:
            raise ValueError("a batch names its documents in the table 'heads'")
        rows = [(batch_id, name, base, df.schema.json()) for name, df in tables.items()]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.path}/_commits/{'base' if base else 'batch'}_{batch_id}")

    def write(self, batch_id: int, make: Callable[[int], dict[str, DataFrame]]) -> bool:
        """Run ``make`` and commit what it staged, unless the batch is committed already."""
        if self.is_committed(batch_id):
            return False
        self.commit(batch_id, make(batch_id))
        return True

    def history(self, table: str, manifest: list | None = None) -> DataFrame | None:
        """All live rows of a table with the ``batch_id`` they came with (those of the base with the last one it holds)."""
        live = [r for r in (self.manifest() if manifest is None else manifest) if r["table"] == table]
        if not live:
            return None
        schema = StructType.fromJson(json.loads(live[-1]["schema"])).add("batch_id", "long")
        parts = []
        for base in (True, False):
            folders = [self._folder(table, r["batch_id"], base) for r in live if r["base"] == base]
            if folders:
                root = f"{self.path}/{table}{'/base' if base else ''}"
                parts.append(self.spark.read.schema(schema).option("basePath", root).parquet(*folders))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def current(self, table: str) -> DataFrame | None:
        """Rows of the latest version of every document: one small row of ``heads`` per document decides."""
        manifest = self.manifest()
        rows = self.history(table, manifest)
        if rows is None:
            return None
        last = self.history(HEADS, manifest).groupBy(self.key).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(last, [self.key, "batch_id"], "left_semi").drop("batch_id")

    def compact(self) -> None:
        """Fold all live batches into a base. Only its manifest switches readers over, so they see the same rows throughout."""
        live = self.manifest()
        if len({(r["batch_id"], r["base"]) for r in live}) < 2:
            return
        last, folded = live[-1]["batch_id"], {}
        for name in sorted({r["table"] for r in live}):
            rows, folder = self.current(name), self._folder(name, last, base=True)
            rows.write.mode("overwrite").parquet(folder)
            folded[name] = self.spark.read.schema(rows.schema).parquet(folder)
        self.commit(last, folded, base=True)

    def vacuum(self) -> None:
        """Delete what the latest base has replaced; readers of older versions must be done."""
        base = max((r["batch_id"] for r in self.manifest() if r["base"]), default=-1)
        for r in self._manifests():
            if r["batch_id"] < base or (r["batch_id"] == base and not r["base"]):
                delete_path(self.spark, self._folder(r["table"], r["batch_id"], r["base"]))
        for r in {(r["batch_id"], r["base"]) for r in self._manifests() if r["batch_id"] < base}:
            delete_path(self.spark, f"{self.path}/_commits/{'base' if r[1] else 'batch'}_{r[0]}")
