"""A master table of first sightings that micro-batches append to, bucketed by the hash of its key.

A batch reads the keys of the buckets that its own keys fall in, and no others.  Its rows go to a folder per bucket; where a bucket has
collected ``merge_at`` folders they are merged into one, so neither folders nor files pile up.  Which folders are live is said by
a manifest per batch, written last: a batch that is run again starts from the manifest before it and replaces its own folders, and
what a merge made obsolete is removed only once the batch that merged it can no longer be run again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.session import Stages, materialize, path_exists, remove_path

Live = dict[int, list[str]]


class Master:
    """``path``: where it lies; ``key``: its unique column; ``buckets``: fixed when the first batch is written."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, merge_at: int = 8):
        self.spark, self.path, self.key, self.buckets, self.merge_at = spark, path.rstrip("/"), key, buckets, merge_at

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    # --- manifests ---

    def _manifest(self, batch_id: int) -> str:
        return f"{self.path}/_manifests/{batch_id:012d}"

    def batches(self) -> list[int]:
        """Batches whose manifest is complete, in order."""
        root = f"{self.path}/_manifests"
        if not path_exists(self.spark, root):
            return []
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        store = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName()) for s in store.listStatus(place)]  # two or three are kept
        return sorted(b for b in found if path_exists(self.spark, f"{self._manifest(b)}/_SUCCESS"))

    def live(self, before: int | None = None) -> tuple[Live, list[str]]:
        """After the last batch (before one): the folders of each bucket, oldest first, and those its merges made obsolete."""
        done = [b for b in self.batches() if before is None or b < before]
        if not done:
            return {}, []
        said = json.loads(self.spark.read.text(self._manifest(done[-1])).head()[0])
        if said["key"] != self.key:
            raise ValueError(f"{self.path} is keyed by {said['key']}, not {self.key}")
        self.buckets = said["buckets"]
        return {int(b): folders for b, folders in said["live"].items()}, said["obsolete"]

    def _declare(self, batch_id: int, live: Live, obsolete: list[str]) -> None:
        said = json.dumps({"key": self.key, "buckets": self.buckets, "live": live, "obsolete": obsolete})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(self._manifest(batch_id))

    # --- rows ---

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def scan(self) -> DataFrame:
        """All rows as of the last batch; fails where there is none yet."""
        live, _ = self.live()
        folders = [f for b in sorted(live) for f in live[b]]
        if not folders:
            raise FileNotFoundError(f"no rows yet in {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def seen(self, keys: DataFrame, live: Live) -> DataFrame | None:
        """The master's keys in the buckets that ``keys`` (with their ``bucket``) touch; None if those are empty."""
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # as many as buckets, at most
        folders = [f for b in touched for f in live.get(b, ())]
        return self._read(folders, keys.select(self.key).schema) if folders else None

    def _write(self, rows: DataFrame, batch_id: int, part: str) -> Live:
        """Rows by bucket below a folder of the batch; the folders written."""
        folder = f"rows/{batch_id}/{part}"
        placed = rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema("bucket int").parquet(f"{self.path}/{folder}").distinct().collect()
        return {r["bucket"]: [f"{folder}/bucket={r['bucket']}"] for r in written}

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Append the rows of keys never seen before; ``rows`` has each key once."""
        live, obsolete = self.live(before=batch_id)
        self._clean(batch_id, obsolete)
        with Stages():
            firsts = materialize(rows.withColumn("bucket", self.bucket()), "batch")
            known = self.seen(firsts, live)
            fresh = firsts
            if known is not None:
                # Whether the batch's keys are broadcast is settled at run time, by their bytes.
                hits = known.join(firsts.select(self.key), self.key, "left_semi")
                fresh = firsts.join(hits, self.key, "left_anti")
            added = self._write(fresh.drop("bucket"), batch_id, "new")
        now = {b: [*live.get(b, ()), *added.get(b, ())] for b in {*live, *added}}
        full = [f for b in now if len(now[b]) >= self.merge_at for f in now[b]]
        if full:
            now |= self._write(self._read(full, rows.schema), batch_id, "merged")
        self._declare(batch_id, now, full)

    def _clean(self, batch_id: int, obsolete: list[str]) -> None:
        """Remove what the batch before made obsolete, and the manifests before its own: it is committed, as the next one runs."""
        for folder in obsolete:
            remove_path(self.spark, f"{self.path}/{folder}")
        for b in [b for b in self.batches() if b < batch_id][:-1]:
            remove_path(self.spark, self._manifest(b))
