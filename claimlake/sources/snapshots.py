"""Tables by claim that are replaced as a whole or not at all.

Claims are hashed into a fixed number of buckets. A write makes new folders for the buckets that it touches and then, as
its last step, a manifest that names one folder per bucket; other buckets keep theirs. Readers take the newest manifest, so
they see a write entirely or not at all, and keep the version that they opened. There is no folder per claim, and nothing
is done claim by claim.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BUCKETS = 64


class Conflict(RuntimeError):
    """Another write became the next version first; nothing of this one is seen."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str, claim: str = "claim_id", buckets: int = BUCKETS):
        """A table under a path; ``buckets`` counts when its first version is written, and stays."""
        self.spark, self.path, self.schema, self.claim = spark, path.rstrip("/"), schema, claim
        held = self._manifest(self.version())
        self.buckets = held["buckets"] if held else buckets

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def versions(self) -> list[int]:
        """Versions that were finished, oldest first."""
        fs, folder = self._file("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 where there is none."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict | None:
        if not version:
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{version}.json").collect()))

    def _publish(self, version: int, manifest: dict) -> None:
        """Name the folders of a version. Whoever makes the claim to its number first writes it; the renaming shows it."""
        fs, mark = self._file(f"manifest/{version}.claim")
        try:
            fs.create(mark, False).close()
        except Exception as taken:
            raise Conflict(f"version {version} of {self.path} is being written by another run") from taken
        fs, hidden = self._file(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(hidden, self._file(f"manifest/{version}.json")[1]):
            raise Conflict(f"version {version} of {self.path} is there already")

    def _bucket(self, claim: str | Column) -> Column:
        return F.pmod(F.xxhash64(claim), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless told; of some buckets only if these are named."""
        held = self._manifest(self.version() if version is None else version)
        folders = sorted({f for b, f in (held or {"folders": {}})["folders"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        wanted = f"{self.schema}, _bucket int"
        # a folder holds all buckets that one write touched; of each only the newest counts
        current = {f: [int(b) for b, g in held["folders"].items() if g == f and (buckets is None or int(b) in buckets)] for f in folders}
        parts = [self.spark.read.schema(wanted).option("basePath", f"{self.path}/{f}").parquet(f"{self.path}/{f}").where(F.col("_bucket").isin(own)) for f, own in current.items()]
        return reduce(DataFrame.unionByName, parts).drop("_bucket")

    def _write(self, rows: DataFrame, touched: list[int], base: int) -> int:
        held = self._manifest(base) or {"folders": {}}
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(self.claim)).repartition(F.col("_bucket"), F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = held["folders"] | {str(b): folder for b in touched}
        self._publish(base + 1, {"version": base + 1, "buckets": self.buckets, "folders": folders})
        return base + 1

    def _touched(self, claims: DataFrame) -> list[int]:
        return [r[0] for r in claims.select(self._bucket(self.claim)).distinct().collect()]  # at most one row per bucket

    def replace(self, rows: DataFrame, claims: DataFrame | None = None) -> int:
        """Replace what the table holds of the claims at hand (those of ``rows`` unless named); returns the version."""
        base = self.version()
        rows = scratch.written(rows, "snapshot-rows")
        named = scratch.written((rows if claims is None else claims).select(self.claim).distinct(), "snapshot-claims")
        touched = self._touched(named)
        left = self.read(base, touched).join(scratch.small(named.select(F.col(self.claim).alias("_gone"))), F.col(self.claim).eqNullSafe(F.col("_gone")), "left_anti")
        return self._write(left.unionByName(rows), touched, base)

    def append(self, rows: DataFrame) -> int:
        """Add rows; returns the version."""
        base = self.version()
        rows = scratch.written(rows, "snapshot-rows")
        touched = self._touched(rows)
        return self._write(self.read(base, touched).unionByName(rows), touched, base)

    def vacuum(self, keep: int = 2) -> None:
        """Remove versions but the newest ones, and folders that no version left names. No write may run meanwhile."""
        versions = self.versions()
        stay = {f for v in versions[-keep:] for f in self._manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            for name in (f"manifest/{v}.json", f"manifest/{v}.claim"):
                fs, where = self._file(name)
                fs.delete(where, False)
        fs, data = self._file("data")
        for f in fs.listStatus(data) if fs.exists(data) else []:
            if f"data/{f.getPath().getName()}" not in stay:
                fs.delete(f.getPath(), True)
