"""Tables in versions: a writer adds a folder and a manifest, and readers see whole versions only.

A version is visible once its manifest has its name, which a rename gives it.  A writer that dies before that leaves the
table as it was.  Two writers that start from one version want the same name; the second one is told so.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsgraph.operators.dedup import upsert


class Conflict(RuntimeError):
    """Another writer has added the version first."""


class VersionedTable:
    """Parquet folders under ``folder``, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("x").getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), conf)

    def version(self) -> int:
        """Number of the latest version, 0 if there is none."""
        at = self._path("manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifests/{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version (the latest if not given), None before the first."""
        version = self.version() if version is None else version
        if not version:
            return None
        manifest = self._manifest(version)
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*(f"{self.folder}/{data}" for data in manifest["data"]))

    def note(self, version: int | None = None) -> dict:
        """What the writer of a version has noted."""
        version = self.version() if version is None else version
        return self._manifest(version)["note"] if version else {}

    def write(self, rows: DataFrame, base: int, note: dict | None = None) -> int:
        """Add ``rows`` as the version after ``base``; raises ``Conflict`` if there is one already."""
        return self._add(rows, base, [], note)

    def append(self, rows: DataFrame, base: int, note: dict | None = None, keep: int | None = None) -> int:
        """As ``write``, with the rows of version ``keep`` (``base`` if not given) kept: only ``rows`` are written."""
        keep = base if keep is None else keep
        return self._add(rows, base, self._manifest(keep)["data"] if keep else [], note)

    def _add(self, rows: DataFrame, base: int, kept: list[str], note: dict | None) -> int:
        data = f"data-{base + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        self._commit(base + 1, {"data": [*kept, data], "schema": rows.schema.jsonValue(), "note": note or {}})
        return base + 1

    def _commit(self, version: int, manifest: dict) -> None:
        jvm = self.spark._jvm
        self._fs.mkdirs(self._path("manifests"))
        draft, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            self._files.rename(draft, name, how)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(name):
                raise Conflict(f"{self.folder}: version {version} exists") from error
            raise

    def upsert(self, rows: DataFrame, keys: list[str], base: int | None = None, note: dict | None = None) -> int:
        """New version in which ``rows`` replace or join those of version ``base`` (the latest if not given) by key.

        Of rows that repeat a key one is kept: the largest by all other columns, so that a repeated run gives the same.
        """
        base = self.version() if base is None else base
        rest = [c for c in rows.columns if c not in keys]
        once = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*rows.columns) if rest else rows.distinct()
        held = self.read(base)
        return self.write(once if held is None else upsert(held, once, keys), base, note)
