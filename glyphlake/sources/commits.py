"""A log of table versions with optimistic concurrency.

Version ``n`` is the file ``n.json`` below the log's folder. It is written under a name of its own and then renamed without
overwriting, so of two writers of one version exactly one wins; the other learns it, reads the winner's state and tries
again. Readers see a version when all it names has been written. Holds wherever the file system renames atomically.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    """Versions below ``path``, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def latest(self) -> tuple[int, dict]:
        """The last version and what it says; (0, {}) before the first."""
        if not self._fs.exists(self._at(self.path)):
            return 0, {}
        names = [status.getPath().getName() for status in self._fs.listStatus(self._at(self.path))]
        version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        return version, self.read(version) if version else {}

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, state: dict) -> bool:
        """Write ``state`` as ``version``; False, and nothing changed, if that version has been written."""
        draft, place = self._at(f"{self.path}/.{uuid.uuid4().hex}"), self._at(f"{self.path}/{version}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        try:
            self._files.rename(draft, place, self._options)
            return True
        except Py4JJavaError as problem:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
