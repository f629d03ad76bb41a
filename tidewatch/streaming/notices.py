"""Notices of alerts: what changed is sent once, to every target, by a stream writer that commits a micro-batch as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import scalars
from tidewatch.operators import rules

NOTICE = "notice_id string, target string, circuit string, alert_type string, title string, message string, ts timestamp"


def addressed(alerts: DataFrame, config: DataFrame, targets: str = "") -> DataFrame:
    """Notices (NOTICE) of the alerts that are to be sent: one for the panel (null target) and one for each target of a comma-separated list.

    alerts: (circuit, alert_type, title, message, critical, ts); config: (circuit, alert_type, enabled). Critical ones go whatever the configuration,
    others unless their type is switched off for the circuit. A notice replaces the one of its circuit and type.
    """
    to = F.concat(F.array(F.lit(None).cast("string")), scalars.items(F.lit(targets)))
    own = rules.alerts(alerts, config).withColumn("target", F.explode(to))
    return own.select(F.concat_ws("_", F.lit("water"), "alert_type", "circuit").alias("notice_id"), "target", "circuit", "alert_type", "title", "message", F.col("ts").cast("timestamp").alias("ts"))


def changed(states: DataFrame) -> DataFrame:
    """The rows of a stream (circuit, alert_type, active, title, message, critical, ts) at which an alert becomes active; it was not so, or not known, before.

    The state of each circuit and type is kept, so an alert that stays active, in a later micro-batch too, gives no second row. Rows of one micro-batch go
    by time, those earlier than what was seen before change nothing.
    """
    out = "circuit string, alert_type string, title string, message string, critical boolean, at long"

    def turn(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        active, seen = kept.get if kept.exists else (False, -(1 << 62))
        rows = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            if row.ts.value <= seen:
                continue
            if row.active and not active:
                rows.append((*key, row.title, row.message, row.critical, row.ts.value // 1000))
            active, seen = bool(row.active), row.ts.value
        kept.update((active, seen))
        yield pd.DataFrame(rows, columns=["circuit", "alert_type", "title", "message", "critical", "at"])

    found = states.groupBy("circuit", "alert_type").applyInPandasWithState(turn, out, "active boolean, seen long", "append", GroupStateTimeout.NoTimeout)
    return found.select("circuit", "alert_type", "title", "message", "critical", F.timestamp_micros("at").alias("ts"))


@dataclass
class Sent(WriterCommitMessage):
    """What one task has staged."""

    path: str | None


class Outbox(DataSource):
    """A folder from which notices are delivered: ``batch=<number>/`` appears as a whole, once for each number. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "notice_outbox"

    def schema(self) -> str:
        return NOTICE

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def write(self, iterator) -> Sent:
        where, base = self._folder()
        lines = [json.dumps(row.asDict(), default=str, ensure_ascii=False) for row in iterator]
        if not lines:
            return Sent(None)
        where.create_dir(f"{base}/_staged")
        path = f"{base}/_staged/{uuid.uuid4().hex}.json"
        with where.open_output_stream(path) as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Sent(path)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803  Spark's name
        where, base = self._folder()
        staged = [m.path for m in messages if m is not None and m.path]
        if where.get_file_info(f"{base}/batch={batchId}").type == fs.FileType.Directory:
            return self.abort(messages, batchId)  # this number was sent before a failure: what was made again is thrown away
        if staged:
            draft = f"{base}/_draft-{batchId}-{uuid.uuid4().hex}"
            where.create_dir(draft)
            for path in staged:
                where.move(path, f"{draft}/{path.rsplit('/', 1)[-1]}")
            where.move(draft, f"{base}/batch={batchId}")
        return None

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        where, _ = self._folder()
        for m in messages:
            if m is not None and m.path and where.get_file_info(m.path).type == fs.FileType.File:
                where.delete_file(m.path)


def send(notices: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Puts a stream of notices into an outbox; run again over the same checkpoint, it sends what is new only."""
    notices.sparkSession.dataSource.register(Outbox)
    return notices.writeStream.format("notice_outbox").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sent(spark: SparkSession, path: str) -> DataFrame:
    """The notices of an outbox, with the number of their micro-batch."""
    return spark.read.schema(NOTICE).option("basePath", path).json(f"{path}/batch=*")
