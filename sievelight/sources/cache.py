"""A cache of scan results that is replaced file by file, a version at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ScanCache:
    """Tables keyed by (repo, file) below one folder, dealt into buckets of repositories.

    A version is one small file that names the folder of each bucket of each table, and is published by one rename: readers
    see a version whole or not at all, and all tables of it together. An upsert writes the buckets it touches anew and
    leaves the others where they are. The version keeps the last batch id; a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets

    # Files of the store ----------------------------------------------------------------------------------

    def _at(self, place: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}" if place else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) holds; an empty cache is version 0."""
        last = version or max(self.versions(), default=0)
        if not last:
            return {"version": 0, "batch": None, "buckets": self.buckets, "tables": {name: {} for name in self.schemas}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{last:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        draft, fs = self._at(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        final, _ = self._at(f"versions/{manifest['version']:012d}.json")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was published by someone else")

    # Rows ------------------------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("repo", F.pmod(F.xxhash64("file"), F.lit(16))), F.lit(self.manifest()["buckets"])).cast("int")

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table in the last version, or another; an empty cache has none."""
        return self._read(name, sorted(self.manifest(version)["tables"].get(name, {}).values()))

    def upsert(self, tables: dict[str, DataFrame], seen: DataFrame, batch: int | None = None) -> bool:
        """Replace what the cache has of the files seen(repo, file) by the rows of tables; False if the batch has been taken before.

        Files that are seen and have no rows are deleted. A batch id must be above the last one.
        """
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return False
        bucket, own = self.bucket(), uuid.uuid4().hex
        seen = seen.select("repo", "file").distinct()
        touched = {r[0] for r in seen.select(bucket).distinct().collect()}  # at most one number for each bucket
        after = {name: dict(before["tables"].get(name, {})) for name in self.schemas}
        for name, schema in self.schemas.items():
            folders = [f for b, f in after[name].items() if int(b) in touched]
            kept = self._read(name, sorted(folders)).join(seen, ["repo", "file"], "left_anti")
            columns = kept.columns
            rows = kept.unionByName(tables[name].select(*columns).join(seen, ["repo", "file"], "left_semi")) if name in tables else kept
            place = f"data/{name}-{own}"
            rows.withColumn("_bucket", bucket).repartition("_bucket", F.pmod(F.xxhash64("file"), F.lit(8))).write.partitionBy("_bucket").parquet(f"{self.path}/{place}")
            path, fs = self._at(place)
            filled = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path) if s.getPath().getName().startswith("_bucket=")}
            for b in map(str, touched):
                after[name].pop(b, None)
            after[name].update({b: f"{place}/_bucket={b}" for b in filled})
        self._publish({"version": before["version"] + 1, "batch": before["batch"] if batch is None else batch, "buckets": before["buckets"], "tables": after})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last `keep` versions names; gives their number."""
        last = self.versions()[-keep:]
        named = {f for v in last for t in self.manifest(v)["tables"].values() for f in t.values()}
        path, fs = self._at("data")
        gone = 0
        for top in fs.listStatus(path) if fs.exists(path) else []:
            for part in fs.listStatus(top.getPath()):
                place = f"data/{top.getPath().getName()}/{part.getPath().getName()}"
                if place not in named and part.isDirectory():
                    gone += bool(fs.delete(part.getPath(), True))
        for v in self.versions()[:-keep]:
            fs.delete(self._at(f"versions/{v:012d}.json")[0], False)
        return gone
