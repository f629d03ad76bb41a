"""Readers of reading histories, entity lists and backups, and the views on the synthetic tables that stand in for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A history as it is stored: state and time may come under short or long names.
RAW_HISTORY = "entity_id string, s string, state string, lu string, last_updated string"

#: Written backups keep microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local master gets one of its own; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a later pass reads it once more instead of making it again."""
    path = f"{shared_folder(df.sparkSession)}/tidewatch/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalised_history(raw: DataFrame) -> DataFrame:
    """(entity_id, ts, state): the time is a number of seconds or ISO text; rows without one are left out."""
    text = F.coalesce("lu", "last_updated")
    ts = F.coalesce(F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("long")), F.try_to_timestamp(text))
    return raw.select("entity_id", ts.alias("ts"), F.coalesce("s", "state").alias("state")).where("ts is not null")


def read_history(spark: SparkSession, path: str, entities: list[str] | None = None, start=None, end=None, entity: str = "entity_id") -> DataFrame:
    """The readings of some entities and a time range from a table with ts and the column entity; both filters reach the scan."""
    out = spark.read.parquet(path)
    if entities is not None:
        out = out.where(F.col(entity).isin(entities))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    return out


def configurable_entities(entities: DataFrame, domains: list[str], prefix: str) -> DataFrame:
    """Entities of some domains whose local name begins with the prefix, by friendly name."""
    local = F.split_part("entity_id", F.lit("."), F.lit(2))
    return entities.where(F.split_part("entity_id", F.lit("."), F.lit(1)).isin(domains) & F.startswith(local, F.lit(prefix))).orderBy("friendly_name", "entity_id")


def read_backup(spark: SparkSession, path: str, table_name: str, schema: T.StructType | str) -> DataFrame:
    """The rows of one table of a backup file ({"tables": {name: [row, ...]}}); unknown columns are dropped, missing ones null.

    The file is one JSON document, as backups are of bounded size; a missing or empty table gives no rows.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField("tables", T.StructType([T.StructField(table_name, T.ArrayType(kind))]))])
    rows = spark.read.schema(whole).json(path, multiLine=True).select(F.explode(f"tables.{table_name}").alias("row"))
    return rows.select("row.*")


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table, written by the tasks; nothing passes through the driver."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").options(**JSON_TIMES).json(f"{path}/{name}")


def configured_circuits(options: DataFrame) -> DataFrame:
    """(circuit, circuit_type, enabled) of options(options: JSON text); without circuits the default two: main, and irrigation as a zone."""
    kind = "struct<circuits:array<struct<circuit:string,circuit_type:string,enabled:boolean>>>"
    default = F.from_json(F.lit('[{"circuit":"main","circuit_type":"fixture"},{"circuit":"irrigation","circuit_type":"zone"}]'), "array<struct<circuit:string,circuit_type:string,enabled:boolean>>")
    found = F.from_json("options", kind)["circuits"]
    rows = options.select(F.explode(F.when(F.size(found) > 0, found).otherwise(default)).alias("c"))
    return rows.select("c.circuit", F.coalesce("c.circuit_type", F.lit("fixture")).alias("circuit_type"), F.coalesce("c.enabled", F.lit(True)).alias("enabled"))


def read_archive(spark: SparkSession, path: str, table_name: str, schema: T.StructType | str) -> DataFrame:
    """One table of a written backup: unknown columns are dropped, missing ones null."""
    return spark.read.schema(schema).options(**JSON_TIMES).json(f"{path}/{table_name}")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events as a view on the events table: one circuit per event type, duration from props, flow from value."""
    k = F.get_json_object("props", "$.k").cast("int")
    flow = F.when(F.col("value").between(0.01, 200), F.col("value")).otherwise(F.lit(0.0))
    fixture = F.when(F.col("user_id") % 12 != 0, F.concat(F.lit("f"), (F.col("user_id") % 12).cast("string")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("circuit"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), k)).alias("end_ts"),
        k.cast("double").alias("duration_seconds"),
        flow.alias("avg_flow_lpm"),
        F.col("value").alias("peak_flow_lpm"),
        (flow * k / 60).alias("volume_litres"),
        ((F.col("user_id") % 50) / 10.0).alias("pressure_delta_psi"),
        (F.col("user_id") % 2 == 1).alias("has_pressure_transient"),
        ((F.col("user_id") % 40) + 30.0).alias("pre_event_pressure_psi"),
        ((F.col("user_id") % 40) + 25.0).alias("min_pressure_psi"),
        fixture.alias("fixture_id"),
        F.when(k % 10 != 9, k % 10).alias("cluster_id"),
        (k % 7 == 0).alias("excluded"),
        (k / 100.0).alias("anomaly_score"),
        (k >= 60).alias("triggered_alert"),
        (F.col("user_id") % 3 / 3.0).alias("flow_variability"),
        F.col("user_id").alias("user_id"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow readings as a view on the events table: (circuit, id, ts, role, state as text, value)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("circuit"), F.col("event_id").alias("id"), "ts", F.lit("flow").alias("role"), F.col("value").cast("string").alias("state"), "value", (F.col("user_id") % 8).alias("sensor"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all roles as a view on the events table: half flow, a quarter pressure, an eighth onset pulses, a sixteenth each meter and gaps."""
    own = readings(spark, sf_dir)
    sensor = F.col("sensor")
    role = F.when(sensor < 4, "flow").when(sensor < 6, "pressure").when(sensor == 6, "onset").when(F.col("id") % 2 == 0, "volume").otherwise("reset")
    state = F.when(role == "onset", F.when(F.col("value") >= 25, "on").otherwise("off")).when(role == "reset", "unavailable").otherwise(F.col("state"))
    return own.withColumns({"role": role, "state": state})


def clusters(events: DataFrame) -> DataFrame:
    """Clusters of the events: the even ones belong to a fixture."""
    own = events.where("cluster_id is not null").groupBy("circuit", "cluster_id").agg(F.count("*").alias("member_count"))
    c = F.col("cluster_id")
    return own.select("circuit", "cluster_id", "member_count", F.when(c % 2 == 0, F.concat(F.lit("f"), c.cast("string"))).alias("fixture_id"), F.when(c % 3 == 1, "toilet").when(c % 3 == 2, "shower").alias("suggested_type"), (c / 10.0).alias("suggested_confidence"))


def fixtures(spark: SparkSession) -> DataFrame:
    """A short list of fixtures."""
    n = F.col("id")
    return spark.range(0, 12).select(F.concat(F.lit("f"), n.cast("string")).alias("fixture_id"), F.when(n % 4 != 0, F.concat(F.lit("Fixture "), n.cast("string"))).alias("fixture_name"), F.when(n % 4 == 2, "toilet").when(n % 4 == 0, "shower").alias("fixture_type"), (n % 3 != 0).alias("confirmed"))
