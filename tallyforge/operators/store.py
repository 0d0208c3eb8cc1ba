"""Tables that are replaced whole or not at all, and runs that change nothing when they are run again.

A table is a folder of versions and a folder of manifests.  A write goes into a new version's
folder; only a manifest, made once it is complete, lets readers see it.  A writer that is killed leaves
a folder that no manifest names.  Manifests are numbered and made exclusively, so of two
writers one commits a number and the other takes the next.  A manifest holds the
content's hash: the same rows again commit nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIMBS = 8


def limbs(line: Column) -> list[Column]:
    """Sums of the 32-bit limbs of all lines' SHA-256: equal for equal multisets, whatever their order and parts."""
    digest = F.sha2(line.cast("binary"), 256)
    return [F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")).alias(f"_l{k}") for k in range(_LIMBS)]


def of_limbs(count: Column) -> Column:
    """One hash of the sums and the number of lines."""
    return F.sha2(F.concat_ws("|", count.cast("string"), *(F.col(f"_l{k}").cast("string") for k in range(_LIMBS))).cast("binary"), 256)


def multiset_hash(rows: DataFrame, line: Column, *keys: str) -> DataFrame:
    """(*keys, sha256) of each key's lines as a multiset, by partial sums: a key may hold any share of the rows."""
    summed = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *limbs(line))
    return summed.select(*keys, of_limbs(F.col("_n")).alias("sha256"))


def _line(df: DataFrame) -> Column:
    """A row as one text; nulls differ from empty texts."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})


class Table:
    """A table at a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def manifests(self) -> list[dict]:
        """All committed versions, oldest first."""
        fs, at = self._fs(f"{self.path}/_manifests")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [json.loads(self._read(f"{self.path}/_manifests/{n}")) | {"number": int(n.split(".")[0])} for n in names]

    def _read(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Make the next free manifest. It is written aside and renamed, which fails where the number is taken."""
        fs, _ = self._fs(self.path)
        _, folder = self._fs(f"{self.path}/_manifests")
        fs.mkdirs(folder)
        number = max((m["number"] for m in self.manifests()), default=0) + 1
        _, aside = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        while True:
            _, final = self._fs(f"{self.path}/_manifests/{number:020d}.json")
            if not fs.exists(final) and fs.rename(aside, final):
                return number
            number += 1

    def write(self, df: DataFrame) -> dict:
        """Commit ``df`` as the table, or nothing if that is what the table holds already."""
        version = uuid.uuid4().hex
        folder = f"{self.path}/_versions/{version}"
        df.write.option("compression", "zstd").parquet(folder)
        held = self.spark.read.schema(df.schema).parquet(folder)
        got = held.agg(F.count("*").alias("_n"), *limbs(_line(held))).select("_n", of_limbs(F.col("_n")).alias("sha256")).first()
        manifest = {"version": version, "rows": got["_n"], "sha256": got["sha256"], "schema": df.schema.json()}
        last = (self.manifests() or [None])[-1]
        if last and (last["sha256"], last["schema"]) == (manifest["sha256"], manifest["schema"]):
            fs, at = self._fs(folder)
            fs.delete(at, True)
            return last | {"committed": False}
        return manifest | {"number": self._commit(manifest), "committed": True}

    def read(self, number: int | None = None) -> DataFrame:
        """The table as of its last manifest, or of the one with that number."""
        from pyspark.sql.types import StructType

        known = {m["number"]: m for m in self.manifests()}
        if not known or (number is not None and number not in known):
            raise FileNotFoundError(f"no committed version at {self.path}")
        m = known[max(known) if number is None else number]
        return self.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{self.path}/_versions/{m['version']}")

    def sweep(self, keep: int = 2) -> int:
        """Delete versions that no manifest names or that are older than the last ``keep``; how many. For times without writers."""
        kept = {m["version"] for m in self.manifests()[-keep:]}
        fs, at = self._fs(f"{self.path}/_versions")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in kept] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
