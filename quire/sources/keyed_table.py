"""Tables by key in files: upserts and deletes that write only the buckets they touch, and versions that are committed at once.

A table is a folder. Its rows lie in buckets by a hash of the key. A version is a manifest, a small file that names the
folder of each bucket; committing is the creation of the next manifest under its number, which fails if there is one
already. So readers see a whole version or the one before, of two writers that began with one version the second
fails, and a writer that dies leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.library import matching, upsert, without


class Conflict(Exception):
    """Another writer has committed the version meanwhile."""


@dataclass
class Version:
    """What a manifest says: its number, the columns, per bucket the folder that holds it, and per source of changes the last that is in."""

    number: int
    schema: dict
    buckets: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class KeyedTable:
    """A table under `root` with a row per key. Its folder must be one that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.keys, self.n = spark, root.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:012d}.json"

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and not n.startswith((".", "_")))

    def _names(self, folder: str) -> list[str]:
        """The names in a folder; none if it isn't there."""
        path = self._path(folder)
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def version(self, number: int | None = None) -> Version | None:
        """A version, the last one if none is named; null if there is none yet."""
        numbers = self._numbers()
        if number is None and not numbers:
            return None
        if number is not None and number not in numbers:
            raise LookupError(f"no version {number}")
        source = self._files.open(self._path(self._manifest(numbers[-1] if number is None else number)))
        try:
            return Version(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def _commit(self, version: Version) -> None:
        """The manifest, written under another name and then given its number in one step, unless that is taken."""
        final, draft = self._path(self._manifest(version.number)), self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        self._files.mkdirs(final.getParent())
        out = self._files.create(draft, False)
        out.write(json.dumps(vars(version)).encode())
        out.close()
        jvm = self.spark._jvm
        try:
            if self._files.getUri().getScheme() == "file":  # a rename would overwrite; a link doesn't
                nio = jvm.java.nio.file.Paths
                to = lambda p: nio.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(to(final), to(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version.number} of {self.root} is another writer's") from None
            raise
        finally:
            self._files.delete(draft, False)

    # --- rows ---

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.n)).cast("int")

    def _rows(self, version: Version | None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of some buckets, or of all; null if there is no version."""
        if version is None:
            return None
        schema = StructType.fromJson(version.schema)
        paths = [f"{folder}/__bucket={b}" for b, folder in version.buckets.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        rows = self._rows(self.version(number))
        if rows is None:
            raise LookupError(f"no table in {self.root}")
        return rows

    def _replace(self, base: Version | None, touched: list[int], rows: DataFrame, source: str | None, number: int | None) -> Version:
        """The next version: the touched buckets hold these rows, all others are as they were."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        bucketed = rows.withColumn("__bucket", self._bucket())
        bucketed.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(folder)
        filled = {n.removeprefix("__bucket=") for n in self._names(folder) if n.startswith("__bucket=")}
        buckets = {b: f for b, f in (base.buckets if base else {}).items() if int(b) not in touched} | dict.fromkeys(filled, folder)
        applied = dict(base.applied if base else {}) | ({source: number} if source else {})
        next_ = Version((base.number if base else -1) + 1, rows.schema.jsonValue(), buckets, applied)
        self._commit(next_)
        return next_

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most one a bucket

    def upsert(self, changes: DataFrame, partial: bool = True, source: str | None = None, number: int | None = None) -> Version:
        """Changes, at most one a key, put in: supplied columns replaced if partial, else whole rows; see library.upsert.

        Changes of a source are numbered upwards, and those whose number is in already are passed over, so they can
        safely be given twice. Raises Conflict if another writer was faster.
        """
        base = self.version()
        if source and base and base.applied.get(source, -1) >= number:
            return base
        touched = self._touched(changes)
        old = self._rows(base, touched)
        rows = changes if old is None else upsert(old, changes, self.keys, partial)
        return self._replace(base, touched, rows, source, number)

    def delete(self, unwanted: dict) -> Version:
        """Rows that equal all unwanted values taken out; an empty filter is refused. Only buckets that hold such a row are written."""
        base = self.version()
        kept, touched = without(self.read(), unwanted), self._touched(matching(self.read(), unwanted))
        return self._replace(base, touched, kept.where(self._bucket().isin(touched)), None, None) if touched else base

    def vacuum(self, keep: int = 2) -> int:
        """Removes all versions but the last `keep`, and data that none of those names; how many folders went.

        Don't call it while a writer is at work: what it has written isn't named yet.
        """
        numbers = self._numbers()
        held = {f.rsplit("/", 1)[1] for n in numbers[-keep:] for f in self.version(n).buckets.values()}
        for n in numbers[:-keep]:
            self._files.delete(self._path(self._manifest(n)), False)
        data, gone = self._path(f"{self.root}/data"), 0
        for f in self._files.listStatus(data) if self._files.exists(data) else ():
            if f.getPath().getName() not in held:
                gone += self._files.delete(f.getPath(), True)
        return gone
