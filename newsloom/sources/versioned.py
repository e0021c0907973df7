"""A store that only grows: folders of rows and of changes under a log of versions.

Each write puts a new folder beside the others and then claims the next version by an
entry in the log; a folder without an entry is not part of the store. Rows are added
once per key. A change holds keys and some fields; readers lay the last change of each
field over the rows. Compaction writes rows and changes so far as one new folder; no
file is ever rewritten or deleted.

An entry is written aside and takes its name only if no other has it, so two writers get
different versions. A writer of rows that comes second looks at what the first one has
added and leaves those keys out. This needs a file system on which a rename does not
replace a file (as HDFS); on a local disk a hard link takes its place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.incremental import last_per_key, matched


class VersionedStore:
    """Rows with unique ``keys`` (null ones are keys too) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self._log = f"{self.path}/log"
        self._fs = self._at(self._log).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self._log))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def entries(self) -> list[dict]:
        """The log in order of its versions: ``version, kind, folder, fields, upto``."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self._log))]
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not names:
            return []
        rows = self.spark.read.text([f"{self._log}/{n}" for n in names]).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda e: e["version"])

    def version(self) -> int:
        """The last version; 0 of an empty store."""
        return max((e["version"] for e in self.entries()), default=0)

    def _claim(self, version: int, entry: dict) -> bool:
        """Make ``entry`` the given version, unless another writer has it."""
        aside = f"{self._log}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(aside), False)
        stream.write(bytearray(json.dumps({"version": version, **entry}).encode()))
        stream.close()
        name = f"{self._log}/{version:012d}.json"
        if self._fs.getUri().getScheme() != "file":
            won = self._fs.rename(self._at(aside), self._at(name))
        else:
            files, to = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Paths
            plain = lambda p: to.get(self._fs.makeQualified(self._at(p)).toUri())
            try:
                files.createLink(plain(name), plain(aside))
                won = True
            except Exception as error:
                if "FileAlreadyExistsException" not in str(error):
                    raise
                won = False
        self._fs.delete(self._at(aside), False)
        return won

    def _written(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def _parts(self, upto: int | None) -> tuple[list[dict], list[dict]]:
        """Entries with rows and entries with changes that make up a version."""
        entries = [e for e in self.entries() if upto is None or e["version"] <= upto]
        base = max((e for e in entries if e["kind"] == "base"), key=lambda e: (e["upto"], e["version"]), default=None)
        after = base["upto"] if base else 0
        rows = [e for e in entries if e["kind"] == "add" and e["version"] > after]
        return ([base] if base else []) + rows, [e for e in entries if e["kind"] == "change" and e["version"] > after]

    def _changes(self, changes: list[dict], fields: list[str]) -> DataFrame:
        """One row per changed key: the last value of each field, as a struct that is null
        where the field was never changed."""
        parts = None
        for e in changes:
            one = self._read([e["folder"]]).select(
                *self.keys, *[F.struct(F.lit(e["version"]).alias("v"), F.col(f).alias("to")).alias(f"_{f}") for f in e["fields"]]
            )
            parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
        return parts.groupBy(*self.keys).agg(*[F.max_by(f"_{f}", F.col(f"_{f}.v")).alias(f"_{f}") for f in fields])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version, the last one by default; None of an empty store."""
        rows, changes = self._parts(version)
        if not rows:
            return None
        df = self._read([e["folder"] for e in rows])
        if not changes:
            return df
        fields = sorted({f for e in changes for f in e["fields"]})
        merged = matched(df, self._changes(changes, fields), self.keys, "left")
        out = [c for c in df.columns if c not in fields]
        for f in fields:
            old = F.col(f) if f in df.columns else F.lit(None)
            out.append(F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.to")).otherwise(old).alias(f))
        return merged.select(*out)

    def add(self, rows: DataFrame, order: list[str]) -> int | None:
        """Add the rows whose key the store does not hold, of a key the last in ``order``.

        Gives the version, or None if there was nothing new. Run again it adds nothing.
        """
        fresh, seen = last_per_key(rows, self.keys, order), 0
        while True:
            now = self.version()
            # Only what has come since the last look, this writer's first look at all.
            held = [e["folder"] for e in self.entries() if e["kind"] in ("add", "base") and seen < e["version"] <= now]
            if held:
                fresh = matched(fresh, self._read(held).select(*self.keys), self.keys, "left_anti")
            folder = self._written(fresh)
            fresh = self._read([folder])
            if not fresh.limit(1).count():
                return None
            if self._claim(now + 1, {"kind": "add", "folder": folder}):
                return now + 1
            seen = now

    def change(self, rows: DataFrame, fields: list[str], order: list[str]) -> int | None:
        """Set ``fields`` of the rows with these keys, a null too; of a key the last in ``order``.

        Keys that the store does not hold change nothing. Other fields, and rows that are
        not named, stay as they are.
        """
        folder = self._written(last_per_key(rows, self.keys, order).select(*self.keys, *fields))
        if not self._read([folder]).limit(1).count():
            return None
        return self._next({"kind": "change", "folder": folder, "fields": list(fields)})

    def compact(self) -> int | None:
        """Write the rows with all changes so far as one folder, for readers to begin with.

        What other writers add meanwhile comes on top of it.
        """
        now = self.version()
        df = self.read(now)
        if df is None:
            return None
        return self._next({"kind": "base", "folder": self._written(df), "upto": now})

    def _next(self, entry: dict) -> int:
        while True:
            version = self.version() + 1
            if self._claim(version, entry):
                return version
