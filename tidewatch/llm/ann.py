"""Approximate nearest neighbours by additive quantisation.

A vector of unit length is encoded as the sum of one full-dimensional codeword from each of several codebooks, found by beam search over
residuals. Its codes, the norm of their sum and the angle between sum and vector are stored; a query scores codes through lookup tables of
its products with the codewords, and all that the angles cannot rule out are ranked again on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize


#: Lengths that the vectors of one table may have.
MOST_LENGTHS = 16


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1)[None, :] - 2 * x @ c.T


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sums) of the rows of x: in each of books (m, k, d) the beam keeps the partial sums with the least residual."""
    n, (m, k, d) = len(x), books.shape
    codes, residual, rows = np.zeros((n, 1, 0), np.uint8), x[:, None, :].astype(np.float32), np.arange(n)[:, None]
    for book in books:
        width = residual.shape[1]
        flat = residual.reshape(n * width, d)
        error = ((flat * flat).sum(1)[:, None] + _squared(flat, book)).reshape(n, width * k)
        keep = min(beam, width * k)
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep]
        residual = residual[rows, best // k] - book[best % k]
        codes = np.concatenate([codes[rows, best // k], (best % k).astype(np.uint8)[:, :, None]], axis=2)
    least = (residual * residual).sum(2).argmin(1)
    return codes[rows[:, 0], least], x - residual[rows[:, 0], least]


def train_books(x: np.ndarray, m: int, k: int, rounds: int = 6, refits: int = 1, seed: int = 5, ridge: float = 10.0) -> np.ndarray:
    """Codebooks (m, k, d): k-means on residuals, then all codewords are fitted jointly by least squares to beam-searched codes."""
    rng = np.random.default_rng(seed)
    residual, books = x.astype(np.float32).copy(), []
    for _ in range(m):
        book = residual[rng.choice(len(residual), k, replace=len(residual) < k)].copy()
        for _ in range(rounds):
            hot = np.zeros((len(residual), k), np.float32)
            hot[np.arange(len(residual)), _squared(residual, book).argmin(1)] = 1
            count, total = hot.sum(0), hot.T @ residual
            book[count > 0] = total[count > 0] / count[count > 0, None]
        residual -= book[_squared(residual, book).argmin(1)]
        books.append(book)
    books = np.stack(books)
    for _ in range(refits):
        gram, target = ridge * np.eye(m * k, dtype=np.float32), ridge * books.reshape(m * k, -1)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            codes, _ = encode(part, books, 4)
            hot = np.zeros((len(part), m * k), np.float32)
            hot[np.arange(len(part))[:, None], codes + k * np.arange(m)] = 1
            gram += hot.T @ hot
            target += hot.T @ part
        books = np.linalg.solve(gram, target).reshape(books.shape).astype(np.float32)
    return books


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part: not null, finite and not zero."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return own.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, books: int = 48, words: int = 64, beam: int = 8, sample: int = 8192, first: int = 16, query_block: int = 256, code_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k nearest others by cosine.

    Codebooks are fitted on the ``sample`` vectors of least hash of the id; all vectors are encoded and scored. Null, zero and non-finite
    vectors take no part, nor do null ids. Equal vectors are one code with its k + 1 smallest ids, which is exact: no list can hold more
    of them. The ``first`` best codes of a query, on original vectors, give a k-th best score; then every code whose stored angle to its
    vector lets the vector reach that score is ranked on original vectors in double precision, ties by smaller id. No neighbour is lost, at
    any number of vectors; the codes decide only how many are ranked. Vectors of each length are searched among themselves; more than
    MOST_LENGTHS lengths raise. With repeated ids each row is a candidate, and queries of one id are answered once, for the row
    of least vector. Empty tables give an empty result; further columns play no part.
    """
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vector_col)
    sizes = own.groupBy(F.size("v").alias("size")).count().orderBy("size").limit(MOST_LENGTHS + 1).collect()
    if len(sizes) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if len(sizes) > 1:
        options = {"id_col": id_col, "vector_col": vector_col, "every": every, "k": k, "books": books, "words": words, "beam": beam, "sample": sample, "first": first, "query_block": query_block, "code_block": code_block}
        return reduce(DataFrame.unionByName, [nearest(vectors.where(F.size(vector_col) == r["size"]), **options) for r in sizes])
    share = 2 * sample / sizes[0]["count"] if sizes else 1.0
    likely = own.where(F.xxhash64("vec_id") < int((share - 0.5) * 2**64)) if share < 1 else own  # so that tasks send few more than sample rows in all
    picked = likely.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()  # bounded by sample
    schema = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return spark.range(0).selectExpr("id query_id", "cast(id as int) rank", "id vec_id", "cast(id as double) score")
    data = np.array([r["v"] for r in picked])
    data = (data / np.linalg.norm(data, axis=1, keepdims=True)).astype(np.float32)
    trained = spark.sparkContext.broadcast(train_books(data, books, min(words, max(2, len(data))), seed=5))

    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = own.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    distinct = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("norm").alias("norm")), "vectors")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), code_block):
                part = batch.slice(at, code_block)
                x = _matrix(part.column(0))
                x = x / part.column(2).to_numpy()[:, None]
                found, sums = zip(*(encode(x[i : i + 512].astype(np.float32), trained.value, beam) for i in range(0, len(x), 512)), strict=True)
                sums = np.concatenate(sums).astype(np.float64)
                norms = np.sqrt((sums * sums).sum(1))
                # A sum of no length says nothing of its vector: its angle counts as a half turn.
                cosine = np.where(norms > 1e-9, np.clip((sums * x).sum(1) / np.maximum(norms, 1e-9), -1, 1), -1.0)
                sizes = np.stack([np.maximum(norms, 1e-9), cosine, np.sqrt(1 - cosine * cosine)]).astype(np.float32)
                ids = part.column(1).to_numpy(zero_copy_only=False)
                low = np.array([i[0] for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([len(low)], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in (low, np.concatenate(found), sizes))], ["n", "ids", "codes", "sizes"])

    blocks = materialize(distinct.select("v", "ids", "norm").mapInArrow(codes, "n int, ids binary, codes binary, sizes binary"), "codes")
    queries = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by(F.struct("v", "norm"), "v").alias("q")).select(F.col("vec_id").alias("query_id"), "q.v", "q.norm")
    queries = materialize(queries, "queries")
    n_blocks = max(1, -(-queries.count() // query_block))

    def work(asked: DataFrame) -> DataFrame:
        """The stated query set against all codes: each block of queries (query_id, v, norm, reach), then the codes, a few bytes a vector."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")
        packed = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "v", "norm", "reach")).alias("queries"))
        dealt = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(packed.select("block"), "block", "left_semi")
        rows = packed.unionByName(dealt, allowMissingColumns=True).select("block", "queries", "n", "ids", "codes", "sizes")
        return rows.repartition("block").sortWithinPartitions("block", F.col("queries").isNull())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(query ids, reach, ids of codes, cosines of their sums with the queries (codes, queries), sizes) of each block of codes, after (query ids,) alone."""
        m, width, size = trained.value.shape
        words_of = trained.value.reshape(m * width, size)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in ("queries", "n", "ids", "codes", "sizes")}
                if row["queries"].is_valid:
                    asked = row["queries"].values
                    q_ids, reach = asked.field(0).to_numpy(), asked.field(3).to_numpy(zero_copy_only=False)
                    table = words_of @ (_matrix(asked.field(1)) / asked.field(2).to_numpy()[:, None]).astype(np.float32).T
                    yield (q_ids,)
                    continue
                n = row["n"].as_py()
                code = np.frombuffer(row["codes"].as_py(), np.uint8).reshape(n, m)
                sizes = np.frombuffer(row["sizes"].as_py(), np.float32).reshape(3, n)
                score = table[code[:, 0]]
                for b in range(1, m):
                    score += table[b * width + code[:, b].astype(np.int64)]
                yield q_ids, reach, np.frombuffer(row["ids"].as_py(), np.int64), score / sizes[0][:, None], sizes

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``first`` best codes of each query."""
        q_ids, ids, best = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids, best.shape).ravel()), pa.array(ids.ravel())], ["query_id", "first_id"])

        for found in scored(batches):
            if len(found) == 1:
                yield from done()
                q_ids, ids, best = found[0], None, None
                continue
            _, _, own_ids, score, _ = found
            own_ids = np.broadcast_to(own_ids[:, None], score.shape)
            ids, best = (own_ids, score) if best is None else (np.concatenate([ids, own_ids]), np.concatenate([best, score]))
            if len(best) > first:
                top = np.argpartition(-best, first - 1, axis=0)[:first]
                ids, best = np.take_along_axis(ids, top, 0), np.take_along_axis(best, top, 0)
        yield from done()

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes whose vectors may score ``reach`` or more: angles on the sphere obey the triangle inequality."""
        for found in scored(batches):
            if len(found) > 1:
                q_ids, reach, ids, score, (_, cosine, sine) = found
                t = np.clip(reach, -1, 1).astype(np.float32)
                u = np.sqrt(1 - t.astype(np.float64) ** 2).astype(np.float32)
                least = np.outer(cosine, t) - np.outer(sine, u)
                code, query = np.nonzero((score >= least - 1e-4) | (t[None, :] <= 1e-6 - cosine[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(ids[code])], ["query_id", "first_id"])

    there = distinct.select(F.element_at("ids", 1).alias("first_id"), "ids", "v", F.col("norm").alias("norm_v"))
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)

    def exact(best: DataFrame) -> DataFrame:
        rows = best.join(there, "first_id").join(queries.select("query_id", F.col("v").alias("q"), F.col("norm").alias("norm_q")), "query_id")
        return rows.select("query_id", F.explode("ids").alias("vec_id"), (dot / (F.col("norm_q") * F.col("norm_v"))).alias("score")).where("vec_id <> query_id")

    pair = "query_id long, first_id long"
    led = exact(work(queries.withColumn("reach", F.lit(-1.0))).mapInArrow(leaders, pair))
    reached = led.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("reach"))
    asked = materialize(queries.join(reached, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(-1.0))), "reach")
    pairs = exact(work(asked).mapInArrow(within_reach, pair))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").to(spark.createDataFrame([], schema).schema)
