"""Several tables that change together: a restore or a migration of all of them takes effect at once or not at all.

Tables are written into new folders beside the old ones; one small manifest then names the folder of each table. A manifest appears by a single rename
to a number of its own, and readers take the largest, so they see all tables of one change or none of it. If a table can't be written, the new
folders go and the manifest that was stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import migrations
from tidewatch.operators.maintenance import dedup_events, insert_missing, normal_timestamp
from tidewatch.sources.history import JSON_TIMES


@dataclass
class State:
    """What a manifest says: the version of the schemas, and folder and columns (as DDL) of each table."""

    number: int = 0
    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)


class TableSet:
    """Tables under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> State:
        """The newest manifest, or an empty state."""
        if not self._fs.exists(self._path(self.base)):
            return State()
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.base)) if f.getPath().getName().startswith("manifest-")]
        if not names:
            return State()
        text = self.spark.read.text(f"{self.base}/{max(names)}", wholetext=True).first()[0]
        return State(**json.loads(text))

    def read(self, name: str) -> DataFrame:
        """A table as the newest manifest has it; KeyError if there is none."""
        folder, ddl = self.state().tables[name]
        return self.spark.read.schema(ddl).parquet(f"{self.base}/{folder}")

    def commit(self, changed: Mapping[str, DataFrame], version: int | None = None) -> State:
        """Puts tables in place of those of their names, all at once; the others stay. Two commits at a time: the later one fails."""
        old = self.state()
        new, made = State(old.number + 1, old.version if version is None else version, dict(old.tables)), []
        try:
            for name, rows in changed.items():
                folder = f"{name}-{uuid.uuid4().hex}"
                made.append(folder)
                rows.write.parquet(f"{self.base}/{folder}")
                new.tables[name] = [folder, rows.schema.toDDL()]
            self._publish(new)
        except BaseException:
            for folder in made:
                self._fs.delete(self._path(f"{self.base}/{folder}"), True)
            raise
        return new

    def _publish(self, new: State) -> None:
        draft, final = self._path(f"{self.base}/draft-{uuid.uuid4().hex}"), self._path(f"{self.base}/manifest-{new.number:012d}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(new.__dict__).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another change was published as number {new.number}")

    def sweep(self) -> int:
        """Deletes folders and manifests that the newest manifest does not name; returns how many. No reader of older ones may be left."""
        now = self.state()
        keep = {folder for folder, _ in now.tables.values()} | {f"manifest-{now.number:012d}"}
        gone = [f.getPath() for f in self._fs.listStatus(self._path(self.base)) if f.getPath().getName() not in keep]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


def restore(target: TableSet, backup: str, tables: Mapping[str, str], keys: Mapping[str, list[str]] | None = None) -> dict[str, int]:
    """Replaces all listed tables (name: columns as DDL) by those of a backup folder of JSON lines, at once; returns the rows of each.

    A table that the backup lacks or has empty becomes empty, so nothing of an earlier state shows through. Unknown columns are dropped, missing ones null.
    Text times named start_ts are normalised to UTC, and rows of the tables in ``keys`` that are then the same event are one, the last of the backup.
    A line that is no JSON object stops the restore and leaves every table as it was.
    """
    spark, rows = target.spark, {}
    for name, ddl in tables.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{backup}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found = spark.read.schema(ddl).options(**JSON_TIMES, mode="FAILFAST").json(f"{backup}/{name}")
            if keys and name in keys:
                if dict(found.dtypes).get("start_ts") == "string":
                    found = found.withColumn("start_ts", normal_timestamp(F.col("start_ts")))
                # the place in the backup: files in order of name, rows in order
                placed = found.withColumns({"__file": F.input_file_name(), "__row": F.monotonically_increasing_id()})
                found = dedup_events(placed.withColumn("__place", F.struct("__file", "__row")), keys[name], "__place").drop("__file", "__row", "__place")
            rows[name] = found
        else:
            rows[name] = spark.createDataFrame([], ddl)
    target.commit(rows)
    return {name: target.read(name).count() for name in tables}


def export_archive(source: TableSet, names: list[str], path: str, exported_at: str) -> None:
    """One Parquet folder per table and the folder _meta of (key, value); tables that the set lacks are left out."""
    known = source.state()
    for name in names:
        if name in known.tables:
            source.read(name).write.parquet(f"{path}/{name}")
    meta = [("backup_type", "history_archive"), ("version", str(known.version)), ("exported_at", exported_at)]
    source.spark.createDataFrame(meta, "key string, value string").coalesce(1).write.parquet(f"{path}/_archive_meta")


def merge_archives(target: TableSet, path: str, keys: Mapping[str, list[str]]) -> dict[str, int]:
    """Adds the rows of an archive whose keys a table lacks, in all tables at once; returns how many each gained.

    What is stored wins; tables that the archive lacks stay, its unknown columns are dropped, missing ones null.
    """
    spark, merged, before = target.spark, {}, {}
    for name, own in keys.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if name in target.state().tables and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored, incoming = target.read(name), spark.read.parquet(f"{path}/{name}")
            known = incoming.select(*[F.col(c) if c in incoming.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes])
            merged[name], before[name] = insert_missing(stored, known, own), stored.count()
    target.commit(merged)
    return {name: target.read(name).count() - n for name, n in before.items()}


def migrate(target: TableSet, to: int = migrations.LATEST) -> list[int]:
    """Brings all tables from the version of the set to another one, at once; returns the versions applied."""
    now = target.state()
    pending = [s for s in migrations.STEPS if now.version < s.version <= to]
    if to > now.version:
        changed = {name: migrations.migrated(target.read(name), name, now.version, to) for name in now.tables if any(s.table == name for s in pending)}
        target.commit(changed, to)
    return sorted({s.version for s in pending})
