"""A keyed table of Parquet files with idempotent batches: upserts, replacements and appends that a replay doesn't repeat.

Rows lie in buckets of their key's hash. A batch writes the buckets that it touches into a folder of its own and then
commits by one rename of a manifest, which names each bucket's folder and the batches it holds. A batch that stopped
half-way left files that no manifest names; one that is run again after its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table at `path`, keyed by `key`. One writer at a time: of two that race, the second is refused."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The last manifest and its number."""
        at = self._fs_path(f"{self.path}/manifest")
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()] if self._fs.exists(at) else []
        if not numbers:
            return 0, {"buckets": {}, "batches": []}
        rows = self.spark.read.text(f"{self.path}/manifest/{max(numbers)}", wholetext=True).first()
        return max(numbers), json.loads(rows[0])

    def _commit(self, number: int, manifest: dict) -> None:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._fs_path(draft))
        out.write(json.dumps(manifest).encode())
        out.close()
        self._fs.mkdirs(self._fs_path(f"{self.path}/manifest"))
        target = self._fs_path(f"{self.path}/manifest/{number}")
        if self._fs.exists(target) or not self._fs.rename(self._fs_path(draft), target):
            raise RuntimeError("another batch was committed meanwhile")

    def _bucket(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        _, manifest = self._manifest()
        return self._read(manifest, None)

    def _read(self, manifest: dict, only: set[int] | None) -> DataFrame:
        folders = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def batches(self) -> list[str]:
        return self._manifest()[1]["batches"]

    def write(self, batch: str, rows: DataFrame, *, mode: str = "upsert", order: list | None = None, by: list[str] | None = None) -> bool:
        """Writes a batch; False if it was committed before.

        upsert: a row takes the place of the one with its key. absent: it comes only if there is none. replace: all rows
        that agree with one of the batch in the columns `by`, a beginning of the key by which the table is dealt, go. Of
        rows of a batch with one key the first by `order` counts.
        """
        number, manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        dealt = by or self.key
        if manifest.get("dealt", dealt) != dealt:
            raise ValueError(f"the table is dealt by {manifest['dealt']}")
        fresh = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        if mode != "replace":
            ranked = F.struct(*(order or [F.xxhash64(*fresh.columns)]), *[F.xxhash64(*fresh.columns)])
            fresh = fresh.groupBy(*self.key).agg(F.min_by(F.struct(*fresh.columns), ranked).alias("r")).select("r.*")
        fresh = fresh.withColumn("bucket", self._bucket(dealt))
        folder = uuid.uuid4().hex
        self_path = f"{self.path}/data/{folder}"
        fresh.write.partitionBy("bucket").parquet(f"{self_path}-new")
        status = self._fs.listStatus(self._fs_path(f"{self_path}-new"))
        touched = {int(f.getPath().getName().partition("=")[2]) for f in status if f.getPath().getName().startswith("bucket=")}
        if touched:
            new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self_path}-new")
            old = self._read(manifest, touched).withColumn("bucket", self._bucket(dealt))
            match = dealt if mode == "replace" else self.key
            if mode == "absent":
                merged = old.unionByName(new.join(old.select(*match), match, "left_anti").select(*new.columns))
            else:
                merged = old.join(new.select(*match).distinct(), match, "left_anti").select(*new.columns).unionByName(new)
            merged.repartition("bucket").write.partitionBy("bucket").parquet(self_path)
        buckets = manifest["buckets"] | {str(b): folder for b in touched}
        self._commit(number + 1, {"buckets": buckets, "batches": [*manifest["batches"], batch], "dealt": dealt})
        self._fs.delete(self._fs_path(f"{self_path}-new"), True)
        return True
