"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step holds at a time inside a task.
SLICE_BYTES = 1 << 21

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_WORD = _U(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local master gets one of its own; a cluster raises, as a local folder would be lost."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidewatch/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewatch_path = path
    return out


def materialize_sorted(df: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """materialize(), dealt by a hash of keys into as many sorted buckets as a shuffle has parts: tables dealt alike join without a new shuffle."""
    spark = df.sparkSession
    path, name = new_path(spark, tag), f"tidewatch_{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._tidewatch_path, out._tidewatch_table = path, name
    return out


def release(*frames: DataFrame) -> None:
    """Deletes tables made by materialize() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        if name := getattr(df, "_tidewatch_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_tidewatch_path", None):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with."""
    prefix = "own_"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once however often use() names it, lambdas included."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Elements that scan() appends to one array before it begins another.
BLOCK = 256


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """The array of out of (state, out) = step(state, item) over items in their order.

    An array that grows is copied at each step; blocks keep that to BLOCK elements, so the whole is near linear.
    """
    none = lambda kind: F.from_json(F.lit("[]"), kind)

    def inner(acc: Column, item: Column) -> Column:
        following, out = step(acc["state"], item)
        return F.struct(following.alias("state"), F.concat(acc["outs"], F.array(out)).alias("outs"))

    def over(all_items: Column) -> Column:
        def outer(acc: Column, at: Column) -> Column:
            begin = F.struct(acc["state"].alias("state"), none(f"array<{out_type}>").alias("outs"))
            return let(F.aggregate(F.slice(all_items, at, BLOCK), begin, inner), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")))

        begin = F.struct(state.alias("state"), none(f"array<array<{out_type}>>").alias("outs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(all_items), F.lit(1)), F.lit(BLOCK)), begin, outer)["outs"])

    return let(items, over)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of a string column, some MB at a time; nulls are empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class WordHasher:
    """64-bit hashes of the words of many texts at once: differences of running polynomial sums."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = _U(pow(int(_WORD), -1, 1 << 64))
            for name, base in (("up", _WORD), ("down", inverse)):
                powers = np.full(n, base, _U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def words(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, start, end) of each word ``[^\\x20\\x09-\\x0D]+``; with lower, A-Z lower-cased."""
        n = len(raw)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none.astype(_U), none, none
        self._powers(n)
        solid = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.zeros(n + 1, bool)
        edge[offsets[(offsets < n)]] = True
        edge[n] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, solid[:-1]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, solid[1:]
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        return np.searchsorted(offsets, start, "right") - 1, self._hashes(raw, start, end), start, end

    def _hashes(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * self.up[: len(raw)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[np.minimum(start, max(0, len(raw) - 1))] + (end - start).astype(_U) * _MULT)

    def spans(self, raw: np.ndarray, offsets: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, start, end) of what lies between separators, empty spans included."""
        self._powers(max(1, len(raw)))
        cuts = np.flatnonzero(raw == separator)
        rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cuts, "right") - 1])
        start = np.concatenate([offsets[:-1], cuts + 1])
        order = np.lexsort((start, rows))
        rows, start = rows[order], start[order]
        end = np.empty_like(start)
        end[:-1] = np.where(rows[1:] == rows[:-1], start[1:] - 1, offsets[rows[:-1] + 1])
        end[-1:] = offsets[-1]
        hashed = self._hashes(raw, start, end) if len(raw) else np.zeros(len(start), _U)
        return rows, hashed, start, end


def shingles(rows: np.ndarray, hashed: np.ndarray, n_rows: int, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; with short, a text of fewer words gives its whole sequence once."""
    if not len(rows):
        return rows, hashed
    running = hashed.copy()
    for step in range(1, size):
        running[: len(hashed) - step] = running[: len(hashed) - step] * _MULT + hashed[step:]
    whole = np.zeros(len(rows), bool)
    if len(rows) >= size:
        whole[: len(rows) - size + 1] = rows[: len(rows) - size + 1] == rows[size - 1 :]
    out_rows, out = rows[whole], mix(running[whole])
    if short:
        counts = np.bincount(rows, minlength=n_rows)
        firsts = np.cumsum(counts) - counts
        few = np.flatnonzero((counts > 0) & (counts < size))
        if len(few):
            own = hashed[firsts[few]].copy()
            for step in range(1, size):
                more = counts[few] > step
                own[more] = own[more] * _MULT + hashed[firsts[few][more] + step]
            out_rows = np.concatenate([out_rows, few])
            out = np.concatenate([out, mix(own + counts[few].astype(_U))])
    return out_rows, out


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A large-binary array of values[bounds[i]:bounds[i + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * values.itemsize, np.int64)), pa.py_buffer(values)]).cast(pa.binary())
