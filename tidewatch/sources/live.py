"""A live subscription of entity states: a data source of partial diffs with its own offsets, their merge into full states, and rewinding.

A subscription is a folder of messages: ``seq=<number>/`` holds text files, each line a JSON object with ``ts``, a message number ``n`` and the changes
``c``: {entity_id: {"+": {"s": state, "a": {attribute: value}}}}. A diff names only what changed. A message that is no such object, and a change without
"+" or with an empty one, says nothing.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.series import running

CHANGE = "seq long, n long, ts timestamp, entity_id string, state string, attributes map<string,string>"
_ARROW = pa.schema([("seq", pa.int64()), ("n", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("entity_id", pa.string()), ("state", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])
#: Rows that the reader hands over at once.
ROWS = 5000


@dataclass
class File(InputPartition):
    """One file of messages, as a task reads it."""

    seq: int
    path: str


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folders(path: str) -> dict[int, str]:
    """The finished folders of messages by number: those with the mark of a finished write, or all if the whole folder has it."""
    where, base = _folder(path)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    whole = any(f.base_name == "_SUCCESS" for f in found)
    seqs = {int(f.base_name[4:]): f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("seq=") and f.base_name[4:].isdigit()}
    return {s: p for s, p in seqs.items() if whole or where.get_file_info(f"{p}/_SUCCESS").type == fs.FileType.File}


def files(path: str, after: int, to: int) -> list[File]:
    """The files of the folders after one number up to another."""
    where, _ = _folder(path)
    out = []
    for seq, folder in sorted(folders(path).items()):
        if after < seq <= to:
            out += [File(seq, f.path) for f in where.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return out


def changes_of(line: str, seq: int, wanted: set[str] | None) -> Iterator[tuple]:
    """The rows of one message."""
    try:
        message = json.loads(line)
        entities, ts = message["c"].items(), datetime.fromisoformat(message["ts"])
    except (ValueError, KeyError, TypeError, AttributeError):
        return
    ts = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
    for entity, diff in entities:
        new = diff.get("+") if isinstance(diff, dict) else None
        if new and (wanted is None or entity in wanted):
            attributes = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (new.get("a") or {}).items() if v is not None}
            state = new.get("s")
            yield seq, message.get("n"), ts, entity, state if state is None or isinstance(state, str) else json.dumps(state), list(attributes.items())


def read_file(path: str, file: File, wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
    """The changes of one file, some rows at a time."""
    where, _ = _folder(path)
    rows: list[tuple] = []
    with where.open_input_stream(file.path) as raw:
        for line in io.TextIOWrapper(raw, "utf-8", errors="replace"):
            rows += changes_of(line, file.seq, wanted)
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class EntityDiffs(DataSource):
    """Options: path; entities, a JSON list of the ids subscribed to (all if absent); maxFolders, how many folders a micro-batch may take."""

    @classmethod
    def name(cls) -> str:
        return "entity_diffs"

    def schema(self) -> str:
        return CHANGE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Options:
    def __init__(self, options) -> None:
        self.path = options["path"]
        chosen = options.get("entities")
        self.wanted = set(json.loads(chosen)) if chosen else None
        self.most = int(options.get("maxFolders", "100"))


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[File]:
        return files(self.path, -1, max(folders(self.path), default=-1)) or [File(-1, "")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_file(self.path, partition, self.wanted)


class _StreamReader(_Options, DataSourceStreamReader):
    """Offsets are {"seq": last folder read, "epoch": rewinds seen, "begin": folder to go on from}.

    A rewind raises the epoch; the batch that ends in the new epoch begins at its ``begin`` instead of where the one before it ended. Offsets are in
    Spark's log, so a batch that is run again after a failure reads the same folders.
    """

    at: dict | None = None

    def initialOffset(self) -> dict:
        return {"seq": -1, "epoch": rewound(self.path)[0], "begin": -1}

    def latestOffset(self) -> dict:
        epoch, begin = rewound(self.path)
        known = sorted(folders(self.path))
        if self.at is None or self.at["epoch"] != epoch:  # after a start the bound counts from the next batch on
            last = known[-1] if known else -1
            return {"seq": last, "epoch": epoch, "begin": begin}
        ahead = [s for s in known if s > self.at["seq"]][: self.most]
        return {"seq": ahead[-1] if ahead else self.at["seq"], "epoch": epoch, "begin": begin}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.at = end
        after = start["seq"] if end["epoch"] == start["epoch"] else min(start["seq"], end["begin"] - 1)
        return files(self.path, after, end["seq"])

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition, self.wanted)

    def commit(self, end: dict) -> None:
        self.at = end


def rewound(path: str) -> tuple[int, int]:
    """(how often this subscription was rewound, the folder that the last rewind went back to)."""
    where, base = _folder(path)
    if where.get_file_info(f"{base}/_rewind.json").type != fs.FileType.File:
        return 0, -1
    with where.open_input_stream(f"{base}/_rewind.json") as raw:
        said = json.loads(raw.read())
    return said["epoch"], said["begin"]


def rewind(spark: SparkSession, path: str, since: datetime) -> int | None:
    """Makes every stream of the subscription go on from the first folder with a message at or after ``since``; returns it, or None without one."""
    begin = subscribed(spark, path).where(F.col("ts") >= F.lit(since)).agg(F.min("seq").alias("s")).first()["s"]
    if begin is not None:
        where, base = _folder(path)
        with where.open_output_stream(f"{base}/_rewind.json.new") as out:
            out.write(json.dumps({"epoch": rewound(path)[0] + 1, "begin": begin}).encode())
        where.move(f"{base}/_rewind.json.new", f"{base}/_rewind.json")
    return begin


def subscribed(spark: SparkSession, path: str, entities: list[str] | None = None, stream: bool = False, max_folders: int = 100) -> DataFrame:
    """The changes (CHANGE) of a subscription, as a table or as a stream."""
    spark.dataSource.register(EntityDiffs)
    reader = (spark.readStream if stream else spark.read).format("entity_diffs").option("path", path).option("maxFolders", max_folders)
    return (reader if entities is None else reader.option("entities", json.dumps(entities))).load()


def write_diffs(changes: DataFrame, path: str, mode: str = "append") -> None:
    """Messages from rows (seq, n, ts, entity_id, state, attributes); null fields are left out of the diff."""
    new = F.struct(F.col("state").alias("s"), F.when(F.size("attributes") > 0, F.col("attributes")).alias("a"))
    diff = F.create_map("entity_id", F.create_map(F.lit("+"), new))
    message = F.to_json(F.struct("n", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), diff.alias("c")))
    changes.select("seq", message.alias("value")).write.mode(mode).partitionBy("seq").text(path)


def full_states(changes: DataFrame, attributes: list[str]) -> DataFrame:
    """changes with ``state`` and one column per attribute as they stand after each change: the last value that any diff of the entity named.

    Changes of one entity go by time, then by message number; those of one message and entity are one change.
    """
    own = changes.withColumns({f"a_{i}": F.try_element_at("attributes", F.lit(a)) for i, a in enumerate(attributes)}).drop("attributes").withColumnRenamed("state", "__said")
    found = running(own, "entity_id", ["ts", "seq", "n"], {"state": ("last", F.col("__said"))} | {a: ("last", F.col(f"a_{i}")) for i, a in enumerate(attributes)})
    return found.drop("__said", *[f"a_{i}" for i in range(len(attributes))])


def full_state_stream(changes: DataFrame, attributes: list[str]) -> DataFrame:
    """full_states() of a stream: each entity's last values are kept as state. A change at or before the last one merged (after a rewind) gives no row."""
    columns = ["entity_id", "seq", "n", "ts", "state", *attributes]
    out = "entity_id string, seq long, n long, ts timestamp, state string" + "".join(f", `{a}` string" for a in attributes)

    def merge(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, values = (kept.get[0], json.loads(kept.get[1])) if kept.exists else ("", [None] * (1 + len(attributes)))
        rows = []
        whole = pd.concat(list(batches)).sort_values(["ts", "seq", "n"])
        for seq, n, ts, state, said in zip(whole["seq"], whole["n"], whole["ts"], whole["state"], whole["attributes"], strict=True):
            place = f"{ts.value:020d}|{int(seq):020d}|{int(n):020d}"
            if place <= last:
                continue
            last, said = place, dict(said or {})
            values = [new if new is not None else old for new, old in zip([state, *[said.get(a) for a in attributes]], values, strict=True)]
            rows.append((key[0], seq, n, ts, *values))
        kept.update((last, json.dumps(values)))
        yield pd.DataFrame(rows, columns=columns)

    return changes.groupBy("entity_id").applyInPandasWithState(merge, out, "last string, vals string", "append", GroupStateTimeout.NoTimeout)


def store_changes(stream: DataFrame, path: str, checkpoint: str, accept=None) -> StreamingQuery:
    """Stores each change once, by (entity_id, seq, n), in folders by seq: what a rewind reads again is only compared with its own folders.

    accept(batch, number) may leave rows out, as a full queue would; a rewind to their earliest time brings them back.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.dropDuplicates(["entity_id", "seq", "n"])
        own = accept(own, number) if accept else own
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            bounds = own.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
            if bounds["a"] is None:
                return
            stored = spark.read.parquet(path).where(F.col("seq").between(bounds["a"], bounds["b"]) & (F.col("batch") != number))
            own = own.join(stored.select("entity_id", "seq", "n"), ["entity_id", "seq", "n"], "left_anti")
        own.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "seq").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
