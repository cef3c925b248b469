"""The reference ledger kept up to date from a stream of change deltas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.references import apply_deltas
from corvane.sources.files import Files

SCHEMA = "ref_table string, key {key}, refs long, exists long"
#: Parts of a ledger, by key. A batch rewrites those with keys it changes.
BUCKETS = 256


class LedgerStream:
    """A ledger under ``folder``, in ``buckets`` parts by key.

    Deltas have the columns ``ref_table, key, refs, exists`` of
    `corvane.operators.references`. A batch writes new versions of the buckets
    it touches and then names each bucket's version in a small file that is
    replaced atomically, so a batch that is repeated after a failure counts
    once, and a reader always sees a whole version. The version before the
    current one stays for its readers. The number of buckets is that of the
    first batch.
    """

    def __init__(self, spark: SparkSession, folder: str, key_type: str = "int", buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._schema = SCHEMA.format(key=key_type)
        self._files = Files(spark)
        self._current = f"{self.folder}/current.json"

    def _state(self) -> dict:
        """``batch``; ``buckets``, the number of parts; ``parts`` and ``before``, each part's batch now and one batch ago."""
        if self._files.exists(self._current):
            return json.loads(self._files.read(self._current))
        return {"batch": None, "buckets": self.buckets, "parts": {}, "before": {}}

    def _path(self, bucket: str, batch: int) -> str:
        return f"{self.folder}/batch={batch}/bucket={bucket}"

    def _read(self, parts: dict[str, int]) -> DataFrame:
        paths = [self._path(k, b) for k, b in parts.items()]
        if not paths:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*paths)

    def ledger(self) -> DataFrame:
        """The ledger after the last whole batch."""
        return self._read(self._state()["parts"])

    def apply(self, deltas: DataFrame, batch: int) -> None:
        """Adds one batch; a batch not newer than the current version is known already."""
        state = self._state()
        if state["batch"] is not None and batch <= state["batch"]:
            return
        bucket = F.pmod(F.xxhash64("ref_table", "key"), F.lit(state["buckets"])).cast("int").alias("bucket")
        touched = [str(r["bucket"]) for r in deltas.select(bucket).distinct().collect()]  # at most as many as there are
        old = self._read({k: b for k, b in state["parts"].items() if k in touched})
        after = apply_deltas(old, deltas).withColumn("bucket", bucket)
        folder = f"{self.folder}/batch={batch}"
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        parts = {k: b for k, b in state["parts"].items() if k not in touched}
        # A bucket whose keys have all left the ledger has no folder.
        parts |= {k: batch for k in touched if self._files.exists(self._path(k, batch))}
        self._files.replace(
            self._current, json.dumps({"batch": batch, "buckets": state["buckets"], "parts": parts, "before": state["parts"]})
        )
        kept = {*parts.items(), *state["parts"].items()}
        for k, b in state["before"].items():
            if (k, b) not in kept:
                self._files.delete(self._path(k, b))

    def start(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keeps the ledger up to date from a streaming DataFrame of deltas."""
        return deltas.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
