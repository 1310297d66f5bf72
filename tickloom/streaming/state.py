"""State between micro-batches, kept by buckets of a key so that a batch rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.session import drop_path

#: Manifests that stay readable: a batch that is run again starts from the one before it.
KEPT_MANIFESTS = 3


class KeyedState:
    """A table of rows by ``key``, versioned by batch and by bucket of the key.

    ``data/version=N/bucket=B`` holds bucket B as batch N left it, ``manifest/batch=N`` names the version of every
    bucket after batch N (one short row per bucket). A batch reads the buckets of its own keys, writes them under its
    number, and commits by its manifest; the other buckets are referred to and not copied. A batch that is run again
    finds the manifest before it and replaces its own folders. Data that no kept manifest names is removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "ticker", buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the keys of ``rows``; at most ``buckets`` numbers."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _names(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in self._names(f"{self.path}/manifest") if n.startswith("batch="))

    def latest(self) -> int:
        """The last batch, or -1 before the first."""
        return max(self._batches(), default=-1)

    def manifest(self, batch_id: int) -> dict[int, int]:
        """Bucket to version after ``batch_id``. Only batch -1, before the first, may be missing."""
        there = self._batches()
        if batch_id < 0:
            if any(b > 0 for b in there):
                raise ValueError(f"{self.path} holds the state of batch {there[-1]}; a new checkpoint needs a new state folder")
            return {}
        if batch_id not in there:
            raise ValueError(f"the state of batch {batch_id} is missing in {self.path}; it holds {there or 'nothing'}")
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/batch={batch_id}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def read(self, batch_id: int, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows left by ``batch_id``, of the given buckets alone."""
        versions = self.manifest(batch_id)
        wanted = versions if buckets is None else [b for b in buckets if b in versions]
        paths = [f"{self.path}/data/version={versions[b]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch_id: int, buckets: Iterable[int]) -> None:
        """Replace ``buckets`` by ``rows``, which must belong to them; all others stay as they are."""
        before = self.manifest(batch_id - 1)
        folder = f"{self.path}/data/version={batch_id}"
        by_bucket = rows.select(*self.schema.names, self.bucket().alias("bucket")).hint("rebalance", "bucket")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {int(n[7:]) for n in self._names(folder) if n.startswith("bucket=")}
        now = {b: v for b, v in before.items() if b not in set(buckets)} | {b: batch_id for b in written}
        entries = self.spark.createDataFrame(sorted(now.items()), "bucket int, version long")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Remove what only manifests older than the kept ones name."""
        old = [b for b in self._batches() if b <= batch_id - KEPT_MANIFESTS]
        for b in old:
            gone, after = self.manifest(b), self.manifest(b + 1)
            for bucket, version in gone.items():
                if after.get(bucket) != version:
                    drop_path(self.spark, f"{self.path}/data/version={version}/bucket={bucket}")
            drop_path(self.spark, f"{self.path}/manifest/batch={b}")
