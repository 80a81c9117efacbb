"""A table kept by key: rows lie in buckets, a change rewrites only the buckets it touches, and a manifest says which files count.

Every commit writes new files beside the old ones and then a new manifest, by
renaming, which either happens or doesn't: a write that is killed leaves the
version before it as it was, and readers see one version throughout. Two writers
of the same version conflict, and the later one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


class KeyedTable:
    """A table of a folder, told apart by one column; ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def versions(self) -> list[int]:
        folder = self._jvm.Path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """``key, buckets, schema`` and, of each bucket that has rows, its folder and number of rows."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {version or ''}".rstrip())
        stream = self._fs.open(self._jvm.Path(f"{self.path}/manifests/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        final = self._jvm.Path(f"{self.path}/manifests/{version}.json")
        draft = self._jvm.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def exists(self) -> bool:
        return bool(self.versions())

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, key: str, buckets: int) -> dict[str, list]:
        """Writes rows to new folders; the folder and number of rows of each bucket that has any."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumn("__bucket", self._bucket(key, buckets))
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        if not seen.get["n"]:
            return {}
        counts = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("__bucket").count().collect()  # a row a bucket, from the files' footers
        return {str(r["__bucket"]): [f"{folder}/__bucket={r['__bucket']}", r["count"]] for r in counts}

    def create(self, rows: DataFrame, key: str, buckets: int = BUCKETS, again: bool = False) -> int:
        """Makes the table of rows, of which a key's last one in the order of all columns counts; with ``again``, in place of what is there. Gives the version."""
        known = self.versions()
        if known and not again:
            raise FileExistsError(self.path)
        last = self._one_each(rows, key)
        manifest = {"key": key, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": self._written(last, key, buckets)}
        version = (known[-1] if known else 0) + 1
        self._commit(version, manifest)
        return version

    def ensure(self, rows: DataFrame, key: str, buckets: int = BUCKETS) -> int:
        """The version that is there, or a table of the rows; a table of another key or other columns is an error."""
        if not self.exists():
            return self.create(rows, key, buckets)
        m = self.manifest()
        if m["key"] != key or {f["name"] for f in m["schema"]["fields"]} != set(rows.columns):
            raise ValueError(f"{self.path} is kept by {m['key']} and has other columns: create it again")
        return self.versions()[-1]

    @staticmethod
    def _one_each(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max(F.struct(*rows.columns)).alias("__row")).select("__row.*")

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{manifest['parts'][b][0]}" for b in buckets if b in manifest["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._rows(m, list(m["parts"]))

    def count(self, version: int | None = None) -> int:
        """From the manifest, without reading a row."""
        return sum(n for _, n in self.manifest(version)["parts"].values())

    def _touched(self, rows: DataFrame, manifest: dict) -> list[str]:
        """Buckets that the rows' keys are in; there are no more of them than the table has."""
        found = rows.select(self._bucket(manifest["key"], manifest["buckets"]).alias("b")).distinct().collect()
        return [str(r["b"]) for r in found]

    def _changed(self, manifest: dict, touched: list[str], rows: DataFrame) -> int:
        version = self.versions()[-1] + 1
        parts = {b: p for b, p in manifest["parts"].items() if b not in touched}
        self._commit(version, manifest | {"parts": parts | self._written(rows, manifest["key"], manifest["buckets"])})
        return version

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in, in place of those with the same key; of several with one key the last in the order of all columns counts."""
        m = self.manifest()
        new = self._one_each(rows.select(*(f["name"] for f in m["schema"]["fields"])), m["key"])
        touched = self._touched(new, m)
        old = self._rows(m, touched)
        return self._changed(m, touched, old.join(new.select(m["key"]), m["key"], "left_anti").select(*new.columns).unionByName(new))

    def set_payload(self, rows: DataFrame, columns: list[str]) -> int:
        """New values of ``columns`` where a key exists and the value isn't null; no key is added."""
        m = self.manifest()
        new = self._one_each(rows.select(m["key"], *columns), m["key"])
        touched = self._touched(new, m)
        old = self._rows(m, touched)
        joined = old.join(new.select(m["key"], *(F.col(c).alias(f"__new_{c}") for c in columns)), m["key"], "left")
        return self._changed(m, touched, joined.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns)))

    def delete(self, keys: DataFrame) -> int:
        """Takes out rows by their keys; a bucket that ends empty leaves the manifest."""
        m = self.manifest()
        touched = self._touched(keys, m)
        old = self._rows(m, touched)
        return self._changed(m, touched, old.join(keys.select(m["key"]).distinct(), m["key"], "left_anti").select(*old.columns))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and the files that none of these names; gives the number of folders gone. No other writer may be at work."""
        known = self.versions()
        held = {folder.split("/")[1] for v in known[-keep:] for folder, _ in self.manifest(v)["parts"].values()}
        for v in known[:-keep]:
            self._fs.delete(self._jvm.Path(f"{self.path}/manifests/{v}.json"), False)
        data, gone = self._jvm.Path(f"{self.path}/data"), 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in held:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
