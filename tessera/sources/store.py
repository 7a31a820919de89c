"""Keyed Parquet tables that are changed by writing the touched buckets anew and switching a pointer."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.upsert import upsert_rows, without_sources
from tessera.schemas import CHUNK_RECORD, MANIFEST
from tessera.sources.cut import cut

BUCKET = "kb_bucket"
DATA, POINTERS = "data", "pointers"
# Stored rows are found by the keys that stay where those of new rows are so many times as many.
FEW = 2


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table with a unique key, partitioned by a hash bucket of one column.

    Bucketing by hash keeps the number of partitions fixed however many sources there are; all
    rows of a source share a bucket, so replacing a source writes one bucket. A change writes its
    buckets to a folder of its own and then a small pointer file that names the folder of every
    bucket. Readers follow the newest pointer, so a run that dies before it leaves the table as it
    was. `buckets` counts for a new table; an old one keeps the number it was written with.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    bucket_by: str = "source_id"
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self._snapshot()[1])).cast("int")

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._hadoop(*parts)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _snapshot(self) -> tuple[int, int, dict[int, str]]:
        """Number of the newest pointer (0 for a new table), number of buckets, and the folder of each bucket."""
        pointers = [name for name in self._names(POINTERS) if name.endswith(".json")]
        if not pointers:
            return 0, self.buckets, {}
        path, fs = self._hadoop(POINTERS, pointers[-1])
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return int(pointers[-1][:-5]), found["buckets"], {int(b): folder for b, folder in found["folders"].items()}

    def _stored(self, only: list[int] | None = None) -> DataFrame:
        """Stored rows, all or those of some buckets; the folders of other buckets are not even listed."""
        schema = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        folders = self._snapshot()[2]
        wanted = sorted(folders if only is None else set(only) & set(folders))
        paths = [f"{self.path}/{DATA}/{folders[b]}/{BUCKET}={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{DATA}").parquet(*paths)
        return rows.select(*schema.names)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def scan_sources(self, sources: list[str]) -> DataFrame:
        """Rows of a short list of sources; only their partitions are read."""
        ids = F.array(*[F.lit(s) for s in sources])
        named = self.spark.range(1).select(F.explode(ids).alias(self.bucket_by))
        return self._stored(self._touched(named)).filter(F.col(self.bucket_by).isin(sources)).drop(BUCKET)

    def partitions_of(self, sources: DataFrame) -> DataFrame:
        """Rows of the partitions that the given rows' sources live in, as a pruned scan."""
        return self._stored(self._touched(sources)).drop(BUCKET)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _write(self, rows: DataFrame) -> str:
        """Writes rows to a new folder that no pointer names yet."""
        folder = f"written={uuid.uuid4().hex}"
        # Rebalancing splits a bucket that one large source has filled and packs small ones.
        spread = rows.select(*[f.name for f in self.schema], self.bucket().alias(BUCKET)).hint("rebalance", BUCKET)
        spread.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{DATA}/{folder}")
        return folder

    def _switch(self, folder: str, touched: list[int], base: tuple[int, int, dict[int, str]]) -> None:
        """Makes a written folder the place of the touched buckets; those without rows in it become empty.

        The pointer is written under another name and renamed, which fails when another run has
        taken the number after that of `base`: of two runs at once, one stops and has changed nothing.
        """
        number, buckets, folders = base
        filled = {int(name.split("=")[1]) for name in self._names(DATA, folder) if name.startswith(f"{BUCKET}=")}
        kept = {b: f for b, f in folders.items() if b not in touched} | {b: folder for b in filled}
        body = json.dumps({"buckets": buckets, "folders": {str(b): kept[b] for b in sorted(kept)}})
        draft, fs = self._hadoop(POINTERS, f"{uuid.uuid4().hex}.draft")
        out = fs.create(draft)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        final, _ = self._hadoop(POINTERS, f"{number + 1:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.path} was changed by another run")

    def _rest(self, stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
        """Stored rows without most of those that `new` has keys of, where few keys stay; else all of them.

        Which stay is seen from the keys alone, and a short list of them can be sent to the stored rows, which then need
        not be shuffled with all their columns.
        """
        if not self._snapshot()[2]:
            return stored
        gone = new.select(key).distinct()
        stay = cut(stored.select(key).distinct().join(gone, key, "left_anti").withColumnRenamed(key, "_stays"))
        if stay.count() * FEW > gone.count():
            return stored
        return stored.join(stay, stored[key].eqNullSafe(stay["_stays"]), "left_semi")

    def upsert(self, new: DataFrame, newest: list[Column] | None = None) -> None:
        """Puts `new` in place of equal keys; `new` is evaluated twice, so write models' output first."""
        base, touched = self._snapshot(), self._touched(new)
        current = self._rest(self._stored(touched).drop(BUCKET), new, self.key)
        self._switch(self._write(upsert_rows(current, new, self.key, newest)), touched, base)

    def replace_sources(self, new: DataFrame, sources: DataFrame) -> None:
        """Puts `new`, rows of listed sources, in place of all rows of these sources."""
        base, touched = self._snapshot(), self._touched(sources)
        kept = without_sources(self._rest(self._stored(touched).drop(BUCKET), sources, "source_id"), sources)
        self._switch(self._write(kept.unionByName(new.select(*[f.name for f in self.schema]))), touched, base)

    def delete_sources(self, sources: DataFrame) -> None:
        self.replace_sources(self.spark.createDataFrame([], self.schema), sources)

    def vacuum(self) -> None:
        """Deletes folders that the newest pointer does not name; run it while nobody reads or writes."""
        used = set(self._snapshot()[2].values())
        for name in self._names(DATA):
            if name not in used:
                path, fs = self._hadoop(DATA, name)
                fs.delete(path, True)


def chunk_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, CHUNK_RECORD, "chunk_id", buckets=buckets)


def manifest_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, path, MANIFEST, "source_id", buckets=buckets)
