"""Packing along a space-filling curve: documents are ordered by the Hilbert key of a low-dimensional projection and cut into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, release

SPECIAL = "<|endoftext|>"


class ByteBpe:
    """The ids of a byte-level BPE: the rank file does the work, the tokenizer file those texts that spell a special token."""

    def __init__(self, ranks: bytes, tokenizer_json: bytes | None, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.size = max(table.values()) + 2
        self.fast = tiktoken.Encoding("tidewatch", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.json, self.full = tokenizer_json, None

    def ids(self, text: str) -> list[int]:
        if self.json is not None and SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_str(self.json.decode())
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def vocabulary(spark, ranks_path: str, json_path: str | None, pattern: str):
    """A broadcast of vocabulary files (a few MB), read by the driver so that executors need no copy."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    data = None
    if json_path:
        with open(json_path, "rb") as f:
            data = f.read()
    return spark.sparkContext.broadcast((ranks, data, pattern))


def hilbert_keys(coords: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of unsigned coordinates (n, d), d * bits <= 62."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, axis by axis
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenized(docs: DataFrame, vocab, id_col: str, text_col: str, end_id: int, dims: int, bits: int, buckets: int, seed: int) -> DataFrame:
    """(doc_id, n, key, ids): the ids of each whole text with the end id, and the Hilbert key of its hashed vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*vocab.value)
        kind = np.uint16 if bpe.size <= 1 << 16 else np.uint32
        hashed = (np.arange(bpe.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets.bit_length() - 1))
        project = np.random.default_rng(seed).standard_normal((buckets, dims))[hashed.astype(np.int64)]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = [np.array([*bpe.ids(t or ""), end_id], np.uint32) for t in part.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                vectors = np.stack([project[x].sum(axis=0) for x in ids])
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                key = hilbert_keys(((vectors + 1) / 2 * ((1 << bits) - 1)).astype(np.int64), bits)
                blobs = pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(key), blobs, pa.array(np.full(len(n), np.dtype(kind).itemsize, np.int32))], ["doc_id", "n", "key", "ids", "width"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, key long, ids binary, width int")


def pack_by_curve(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, dims: int = 3, bits: int = 20, buckets: int = 4096, seed: int = 11) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece of a document in a sequence.

    Documents follow each other along the Hilbert curve and are cut where a sequence of ``length`` ends, so only the last sequence is
    padded. A null or empty text is the end id alone. Rows of the same id, and copies, are packed each for itself; ties of the key go by
    id, then by row. Null ids stay null. An empty table gives no pieces; further columns play no part.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, vocab, id_col, text_col, end_id, dims, bits, buckets, seed).withColumn("row", F.monotonically_increasing_id()), "ids")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "doc_id", "row"]
    ranged = tokens.select("row", "doc_id", "key", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "curve")
    totals = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    before, total = {}, 0
    for part, n in totals:
        before[part], total = total, total + n
    starts = F.broadcast(spark.createDataFrame(list(before.items()), "part int, before long"))  # one row a partition
    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.select("row", "part", (F.sum("n").over(running) - F.col("n")).alias("within"))
    placed = within.join(starts, "part").select("row", (F.col("before") + F.col("within")).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            bases, widths, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for i in range(len(batch)):
                own = np.frombuffer(batch.column(3)[i].as_py(), f"<u{widths[i]}").astype("<u4")
                at = 0
                while at < len(own):
                    sequence, offset = divmod(bases[i] + at, length)
                    end = min(len(own), at + length - offset)
                    rows.append((ids[i], at, end - at, zlib.crc32(own[at:end].tobytes()), len(own), sequence, offset))
                    at = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    joined = tokens.select("row", "doc_id", "width", "ids").join(placed, "row").select("doc_id", "base", "width", "ids")
    return joined.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
