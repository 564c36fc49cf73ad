"""Tables that change as a whole: readers see one finished version, and a job may replace what it reads.

The rows of a version lie in folders of their own below ``root/rows``. A small file below ``root/commits``, named by its
number, says which folders make up that version. It is written under another name and renamed, so it is there in full or
not at all, and two writers cannot both take the same number: the second one fails and leaves the table as it was. What a
failed write leaves behind belongs to no version and is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from harborline.operators.ordering import first_per_key
from harborline.sources.files import newest_upload, scan_csv, upsert_by_key

DIGITS = 12
# A version of more parts than this is written anew as one.
MOST_PARTS = 16


class Conflict(Exception):
    """Somebody else has committed since this change read the table."""


@dataclass(frozen=True)
class Version:
    """One state of a table: its ``parts`` in the order of their writing; of rows with equal ``key`` the last part's counts."""

    number: int
    schema: str
    parts: tuple[str, ...]
    key: tuple[str, ...] = ()
    operation: str = "replace"
    # The last batch of each stream, and the upload, that this version holds.
    batches: dict[str, int] = field(default_factory=dict)
    upload: str | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Commits.

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        """The store's file interface, whatever store it is."""
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path().toUri() if self._path().toUri().getScheme() else self._path().getFileSystem(self._settings()).getUri(), self._settings()
        )

    def _settings(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def numbers(self) -> list[int]:
        """The numbers of all versions that are kept."""
        store, folder = self._path().getFileSystem(self._settings()), self._path("commits")
        if not store.exists(folder):
            return []
        names = [f.getPath().getName() for f in store.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self, number: int | None = None) -> Version | None:
        """The newest version or the one with a number; None where there is none."""
        numbers = self.numbers()
        wanted = number if number is not None else (numbers[-1] if numbers else None)
        if wanted is None or wanted not in numbers:
            return None
        stream = self._path().getFileSystem(self._settings()).open(self._path("commits", f"{wanted:0{DIGITS}d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Version(**found | {"parts": tuple(found["parts"]), "key": tuple(found["key"])})

    def _commit(self, version: Version) -> Version:
        jvm, store = self.spark._jvm, self._path().getFileSystem(self._settings())
        hidden = self._path("commits", f".{uuid.uuid4().hex}")
        out = store.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(asdict(version)).encode()))
        finally:
            out.close()
        # Without the option to overwrite, a rename fails where the name is taken.
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files().rename(hidden, self._path("commits", f"{version.number:0{DIGITS}d}.json"), no_options)
        except Exception as e:
            store.delete(hidden, False)
            if version.number in self.numbers():
                raise Conflict(f"{self.root}: version {version.number} has been committed by somebody else") from e
            raise
        return version

    def _write(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/rows/{part}")
        return part

    # Reading.

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the newest version, or of the one with a number."""
        version = self.version(number)
        if version is None:
            raise FileNotFoundError(f"{self.root} has no version {'' if number is None else number}".rstrip())
        return self._rows(version)

    def _rows(self, version: Version) -> DataFrame:
        schema = StructType.fromJson(json.loads(version.schema))
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/rows/{p}") for p in version.parts]
        if len(parts) == 1:
            return parts[0]
        rows = None
        for n, part in enumerate(parts):
            part = part.withColumn("_part", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        return first_per_key(rows, list(version.key), [-F.col("_part")]).drop("_part")

    def history(self) -> DataFrame:
        """One row for each version that is kept: number, operation, parts, upload."""
        rows = [(v.number, v.operation, len(v.parts), v.upload) for v in map(self.version, self.numbers())]
        return self.spark.createDataFrame(rows, "number int, operation string, parts int, upload string")

    # Changes. Each of them gives the version that holds it.

    def replace(self, df: DataFrame, operation: str = "replace", upload: str | None = None, after: Version | None = None) -> Version:
        """All rows anew. ``df`` may read this table; ``after`` is the version it comes from (default: the newest one now)."""
        before = after or self.version()
        number = before.number + 1 if before else 1
        return self._commit(Version(
            number, df.schema.json(), (self._write(df),), before.key if before else (), operation, before.batches if before else {},
            upload or (before.upload if before else None),
        ))

    def upsert(self, updates: DataFrame, key: str, defaults: dict[str, object], newest: str | None = None) -> Version:
        """The rows with ``updates`` as in ``files.upsert_by_key``; the table is read and replaced in one change."""
        before = self.version()
        if before is None:
            raise FileNotFoundError(f"{self.root} has no version")
        return self.replace(upsert_by_key(self._rows(before), updates, key, defaults, newest), "upsert", after=before)

    def merge(self, rows: DataFrame, key: list[str], stream: str | None = None, batch: int | None = None) -> Version:
        """Whole rows by key: new ones come in, old ones are replaced. Only ``rows`` are written, until many parts become one.

        ``rows`` must have each key once. With ``stream`` and ``batch`` a batch that the table holds already changes nothing.
        """
        before = self.version()
        if before and stream is not None and before.batches.get(stream, -1) >= batch:
            return before
        if before and before.key and before.key != tuple(key):
            raise ValueError(f"{self.root} is keyed by {before.key}")
        if before and not before.key and before.parts:
            raise ValueError(f"{self.root} has no key; merging needs a table that began with a merge")
        if before:
            rows = rows.select(*StructType.fromJson(json.loads(before.schema)).fieldNames())
        batches = (before.batches if before else {}) | ({stream: batch} if stream is not None else {})
        merged = self._commit(Version(
            before.number + 1 if before else 1, before.schema if before else rows.schema.json(),
            (*(before.parts if before else ()), self._write(rows)), tuple(key), "merge", batches,
        ))
        return self.compact(merged) if len(merged.parts) > MOST_PARTS else merged

    def compact(self, before: Version | None = None) -> Version:
        """The same rows in one part."""
        before = before or self.version()
        return self._commit(replace(before, number=before.number + 1, parts=(self._write(self._rows(before)),), operation="compact"))

    def forget(self, keep: int = 1) -> int:
        """Drop all but the newest ``keep`` versions and the rows that none of these has; the number of folders dropped.

        Not while a change is being written: its rows belong to no version yet.
        """
        store, numbers = self._path().getFileSystem(self._settings()), self.numbers()
        kept = {p for n in numbers[-keep:] for p in self.version(n).parts}
        for n in numbers[:-keep]:
            store.delete(self._path("commits", f"{n:0{DIGITS}d}.json"), False)
        folders = [f.getPath() for f in store.listStatus(self._path("rows"))] if store.exists(self._path("rows")) else []
        dropped = [f for f in folders if f.getName() not in kept]
        for f in dropped:
            store.delete(f, True)
        return len(dropped)

    def sync_latest(self, folder: str, schema: StructType, kind: str | None = None) -> Version | None:
        """Replace the table by the newest upload below ``folder`` (of ``kind`` if given), unless it holds that one already.

        None if there is no upload and no version.
        """
        found, before = newest_upload(self.spark, folder, kind), self.version()
        if found is None:
            return before
        path, changed = found
        upload = f"{path}@{changed.isoformat()}"
        if before and before.upload == upload:
            return before
        return self.replace(scan_csv(self.spark, path, schema), "sync", upload, before)
