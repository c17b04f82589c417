"""A table kept by key: hash buckets of the key, versions of buckets, and a manifest for each version of the whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlake.sources import files

#: Buckets of a new store. A bucket is what one change rewrites, so there should be many for a large store.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer made the next version first; read again and repeat the change."""


class KeyedStore:
    """Rows of one schema in hash buckets of their key columns.

    A change reads and rewrites only the buckets that its keys fall into, into a folder of its own; then one small file, the manifest, names the folder of each bucket, and writing that file is what makes the
    version. So a change that dies leaves the former version as it was, and what it costs follows the change, not the store. Manifests are numbered and never overwritten: of two writers one gets the
    number, the other a Conflict. Readers hold a version, which stays readable until vacuum() takes it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.buckets = int(self.manifest().get("of", buckets))

    # ---- versions --------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in files.names(self.spark, f"{self.root}/manifests") if n[:1] != "." and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """version, of (buckets in all), buckets (number to folder), batch (the last one applied). Without a version the newest."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version == 0:
            return {"version": 0, "buckets": {}, "batch": None}
        return json.loads(files.read_text(self.spark, f"{self.root}/manifests/{version:012d}.json"))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, without one of the newest."""
        return self._rows(list(self.manifest(version)["buckets"].values()))

    def bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*(keys or [F.col(k) for k in self.keys])), F.lit(self.buckets)).cast("int")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys are among wanted's; only their buckets are read."""
        touched = self._touched(wanted)
        now = self.manifest()["buckets"]
        return self._rows([now[b] for b in touched if b in now]).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[str]:
        # at most as many as there are buckets
        return sorted(str(r.b) for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # ---- changes ---------------------------------------------------------------------------------

    def change(self, incoming: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> dict:
        """The next version: in each bucket that incoming touches the rows are fold(rows, incoming). Returns its manifest.

        fold must keep keys in their buckets, that is to work key by key. incoming should be a table or a batch that reads the same each time. A batch that the newest version has
        applied already, or an older one, changes nothing: a stream may repeat its last batch.
        """
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return before
        touched = self._touched(incoming)
        now = before["buckets"]
        name = f"v{before['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        after = {b: f for b, f in now.items() if b not in touched}
        if touched:
            folded = fold(self._rows([now[b] for b in touched if b in now]), incoming).withColumn("bucket", self.bucket())
            # small buckets share a task, a large one is dealt to several, by its size
            folded.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
            after |= {f[7:]: f"{name}/{f}" for f in files.names(self.spark, f"{self.root}/data/{name}") if f.startswith("bucket=")}
        made = {"version": before["version"] + 1, "of": self.buckets, "buckets": after, "batch": before["batch"] if batch is None else batch}
        if not files.write_new(self.spark, f"{self.root}/manifests/{made['version']:012d}.json", json.dumps(made)):
            files.remove(self.spark, f"{self.root}/data/{name}")
            raise Conflict(f"version {made['version']} of {self.root} is there already")
        return made

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the newest `keep` versions: their manifests first, then bucket folders that no version names, those of dead changes among them. Returns what went.

        To be called when no change is under way.
        """
        have = self.versions()
        for version in have[:-keep]:
            files.remove(self.spark, f"{self.root}/manifests/{version:012d}.json")
        named = {f for v in have[-keep:] for f in self.manifest(v)["buckets"].values()}
        gone = []
        for name in files.names(self.spark, f"{self.root}/data"):
            inner = [f"{name}/{b}" for b in files.names(self.spark, f"{self.root}/data/{name}") if b.startswith("bucket=")]
            dead = [b for b in inner if b not in named]
            if len(dead) == len(inner):
                dead = [name]
            for f in dead:
                files.remove(self.spark, f"{self.root}/data/{f}")
            gone += dead
        return gone
