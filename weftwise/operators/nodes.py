"""A table of nodes that grows by whole writes.

A write puts its rows into a folder of its own and then commits: it creates the next numbered file below ``commits``,
which fails if another writer was faster (then the write looks again at what is there). Readers read the folders that
commits name, so they see whole writes only. A node's id is made from its content; a write adds only nodes that no commit
has, so a write that is run again adds nothing, and ids are unique over all writes. What a broken write leaves behind is
named by no commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.operators.attributes import payload
from weftwise.operators.work import settle

SCHEMA = "id string, payload string"


class NodeStore:
    """Nodes (id, payload) below ``path``, in any format that Spark writes to folders."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self._log = self._hadoop(f"{self.path}/commits")
        self._files = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        return sorted(x.getPath().toString() for x in self._files.listStatus(self._log) if x.getPath().getName().endswith(".json")) if self._files.exists(self._log) else []

    def commits(self) -> list[dict]:
        """What has been committed, in order: one small entry a write. An entry that isn't written out yet doesn't count."""
        names = self._names()
        rows = self.spark.read.text(names, wholetext=True).select("value", "_metadata.file_name").collect() if names else []
        return [json.loads(text) for text, _ in sorted(rows, key=lambda r: r[1]) if text]

    def read(self) -> DataFrame:
        """All nodes of committed writes; none if there are none."""
        return self._folders([c["folder"] for c in self.commits()])

    def _folders(self, folders: list[str]) -> DataFrame:
        found = [f"{self.path}/{x}" for x in folders]
        return self.spark.read.format(self.fmt).schema(SCHEMA).load(found) if found else self.spark.createDataFrame([], SCHEMA)

    def write(self, nodes: DataFrame, node_type: str) -> DataFrame:
        """Add nodes (attrs) of a type; returns (id, payload) of all that were given, each once."""
        empty = F.create_map().cast("map<string,string>")
        made = settle(nodes.select(payload(node_type, empty, F.col("attrs")).alias("payload")).select(F.sha2("payload", 256).alias("id"), "payload").distinct())
        while True:
            number = len(self._names())
            fresh = made.join(self.read().select("id"), "id", "left_anti").select("id", "payload")
            folder = f"data/{uuid.uuid4().hex}"
            fresh.write.format(self.fmt).save(f"{self.path}/{folder}")
            if self._folders([folder]).isEmpty() or self._commit(number, {"folder": folder, "type": node_type}):
                return made

    def _commit(self, number: int, entry: dict) -> bool:
        """Create the numbered commit; false if another writer has."""
        at = self._hadoop(f"{self.path}/commits/{number:012d}.json")
        try:
            out = self._files.create(at, False)
        except Exception:
            if self._files.exists(at):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True
