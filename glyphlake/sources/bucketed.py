"""The document index in buckets by id, for partial updates and point reads.

A document's bucket is a hash of its id. Every update writes new files for the buckets it touches alone and commits a version
that tells, for each bucket, which folder holds it; all other buckets keep their files. Point reads open only the buckets of the
asked ids, sorted by id inside and with a Bloom filter in every file. Updates meet the log's versions optimistically: where another
writer was first and touched other buckets, the files written stand; where it touched the same, the update is merged again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphlake.operators.joins import lookup_join
from glyphlake.operators.upsert import latest_fields, upsert
from glyphlake.session import cut_lineage
from glyphlake.sources.commits import CommitLog

SEED = 17
#: Ids of a point read that are handed to the scan as a filter, which Bloom filters and row group bounds can use.
FILTERED_IDS = 1000
ROWS_PER_FILE = 1 << 20


class BucketedIndex:
    """An index below ``root``; ``create`` writes its first version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    @classmethod
    def create(cls, df: DataFrame, root: str, buckets: int, id_col: str = "doc_id") -> BucketedIndex:
        """Write ``df`` as the first version. Every version lists its buckets, so choose thousands rather than millions."""
        made = cls(df.sparkSession, root)
        state = {"buckets": buckets, "id": id_col, "held": {}, "schema": df.schema.json()}
        state["held"] = made._write(df, state)
        if not made.log.commit(1, state):
            raise ValueError("the index exists")
        return made

    def _bucket(self, state: dict, name: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.lit(SEED), F.col(name or state["id"])), F.lit(state["buckets"])).cast("int")

    def _write(self, df: DataFrame, state: dict) -> dict[str, str]:
        """Write rows to a folder of their own; tells the folder of every bucket written."""
        folder, key = uuid.uuid4().hex, state["id"]
        rows = df.withColumn("__bucket", self._bucket(state))
        ordered = rows.repartition(min(state["buckets"], 4096), "__bucket").sortWithinPartitions("__bucket", key)
        writer = ordered.write.partitionBy("__bucket").option("maxRecordsPerFile", ROWS_PER_FILE)
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.root}/data/{folder}")
        held = self.spark.read.schema("__bucket int").parquet(f"{self.root}/data/{folder}").select("__bucket").distinct()
        return {str(r[0]): folder for r in held.collect()}  # at most one row a bucket

    def _rows(self, state: dict, buckets: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        held = {b: f for b, f in state["held"].items() if buckets is None or b in buckets}
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}/__bucket={b}" for b, f in sorted(held.items())])

    def version(self) -> int:
        return self.log.latest()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """All documents, of an earlier version if asked."""
        return self._rows(self.log.latest()[1] if version is None else self.log.read(version))

    def _touched(self, state: dict, ids: DataFrame) -> set[str]:
        return {str(r[0]) for r in ids.select(self._bucket(state).alias("b")).distinct().collect()}

    def get(self, ids: DataFrame) -> DataFrame:
        """Documents of the asked ids, from the files of their buckets alone; unknown ids give no row."""
        _, state = self.log.latest()
        key = state["id"]
        asked = cut_lineage(ids.select(key).where(F.col(key).isNotNull()).distinct())
        rows = self._rows(state, self._touched(state, asked))
        few = asked.limit(FILTERED_IDS + 1).collect()
        if len(few) <= FILTERED_IDS:
            return rows.where(F.col(key).isin([r[0] for r in few]))
        return lookup_join(rows, asked, key, "left_semi")

    def exists(self, ids: DataFrame) -> DataFrame:
        """The asked ids with a flag telling whether the index holds them."""
        key = self.log.latest()[1]["id"]
        asked = cut_lineage(ids.select(key).distinct())
        found = self.get(asked).select(key, F.lit(True).alias("found"))
        return asked.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def upsert(self, updates: DataFrame, order_by: str | list[str] | None = None) -> int:
        """Merge partial documents as ``operators.upsert`` does; returns the new version.

        ``updates`` has columns of the index, besides those of ``order_by``. No update, no new version.
        """
        version, state = self.log.latest()
        changes = updates if order_by is None else latest_fields(updates, order_by, state["id"])
        changes = cut_lineage(changes)
        more = set(changes.columns) - {f.name for f in self._rows(state).schema.fields}
        if more:
            raise ValueError(f"the index has no column {sorted(more)}")
        touched = self._touched(state, changes)
        if not touched:
            return version
        written = self._merged(state, changes, touched)
        while not self.log.commit(version + 1, {**state, "held": {**state["held"], **written}}):
            # Another writer was first. Its version may be several on; what was written stands unless it changed these buckets.
            before = {b: state["held"].get(b) for b in touched}
            version, state = self.log.latest()
            if {b: state["held"].get(b) for b in touched} != before:
                written = self._merged(state, changes, touched)
        return version + 1

    def _merged(self, state: dict, changes: DataFrame, touched: set[str]) -> dict[str, str]:
        old = self._rows(state, touched)
        return self._write(upsert(old, changes, id_col=state["id"]).select(*old.columns), state)
