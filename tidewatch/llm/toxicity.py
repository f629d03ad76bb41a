"""Toxicity scores of whole texts by a factorization machine over hashed terms, trained here.

Terms are words and their beginnings, and terms that two words of a passage share. A passage is two neighbouring blocks of words; its score adds a
weight for each of its terms and, for each pair of them, the product of two short vectors (their mean over the terms), so that an insult weighs
otherwise beside the mention of a group than alone. A text scores as its worst passage, whatever its length, and the machine learns from just that passage of each labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, materialize, mix, release, text_slices

#: Bits of a hashed term, values of its vector, words of a block, bytes of the beginnings that are terms, distinct texts of the sample that must hold a term.
BITS, FACTORS, BLOCK, STEMS, LEAST = 18, 8, 128, (4, 5, 6, 7, 8), 3
#: The sample that the machine learns from: distinct texts of each label, bytes of text of each label, bytes of one text. Larger tables give as large a sample.
SAMPLE, SAMPLE_BYTES, TEXT_BYTES = (4_000, 2_000), 12_000_000, 1_000_000
_TWICE = np.uint64(0xA24BAED4963EE407)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of letters and digits; every byte beyond ASCII is a letter."""
    n = len(raw)
    solid = (raw >= 128) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90))
    edge = np.zeros(n + 1, bool)
    edge[offsets[offsets < n]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | np.append(edge[1:-1], True))) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def block_terms(hasher: WordHasher, raw: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term) pairs, each once and in order, and the row of each block; with known, other terms are left out."""
    rows, start, end = word_spans(raw, offsets)
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none, none, none
    hasher._powers(len(raw))
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = place % BLOCK == 0
    block = np.cumsum(first) - 1
    block_rows = rows[first]
    whole = hasher._hashes(raw, start, end)
    order = np.lexsort((whole, block))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (whole[order][1:] != whole[order][:-1]) | (block[order][1:] != block[order][:-1])
    words = order[fresh]  # each word of a block once
    hashes, blocks = [whole[words]], [block[words]]
    for size in STEMS:
        longer = words[end[words] - start[words] > size]
        hashes.append(hasher._hashes(raw, start[longer], start[longer] + size))
        blocks.append(block[longer])
    hashed, of = np.concatenate(hashes), np.concatenate(blocks).astype(np.int64)
    twice = _twice(hashed, of)
    key = np.concatenate([(of << BITS) | _slot(hashed), twice])
    if known is not None:
        key = key[known[key & ((1 << BITS) - 1)]]
    key = np.unique(key)
    return key >> BITS, key & ((1 << BITS) - 1), block_rows


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BITS)).astype(np.int64)


def _twice(hashed: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Keys of the terms that two different words of a block share."""
    order = np.lexsort((hashed, of))
    same = (hashed[order][1:] == hashed[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = order[1:][same]
    return (of[again] << BITS) | _slot(mix(hashed[again] ^ _TWICE))


@dataclass
class Machine:
    """Bias, weights and vectors of the terms, which terms it knows, and a line that turns its sums into log-odds."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    known: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def sums(self, block: np.ndarray, term: np.ndarray, n_blocks: int) -> np.ndarray:
        """For each block: sum of weights, sum of squares, number of terms, sum of vectors."""
        out = np.zeros((n_blocks, 3 + self.vectors.shape[1]))
        if len(block):
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            v = self.vectors[term]
            out[block[at]] = np.column_stack([np.add.reduceat(self.weights[term], at), np.add.reduceat((v * v).sum(axis=1), at), np.diff(np.append(at, len(block))), np.add.reduceat(v, at, axis=0)])
        return out

    def passages(self, sums: np.ndarray, block_rows: np.ndarray) -> np.ndarray:
        """The score of each block with the next one of its row; a row's last block stands alone if it is the only one, else it is not scored (-inf)."""
        both = sums.copy()
        joined = block_rows[1:] == block_rows[:-1]
        both[:-1][joined] += sums[1:][joined]
        out = self.bias + both[:, 0] + ((both[:, 3:] ** 2).sum(axis=1) - both[:, 1]) / 2 / np.maximum(both[:, 2], 1)
        late = np.append(False, joined) & ~np.append(joined, False)
        out[late] = -np.inf
        return out

    def rows(self, block: np.ndarray, term: np.ndarray, block_rows: np.ndarray, n_rows: int) -> np.ndarray:
        """The score of each row: that of its worst passage, or the bias where it has no word."""
        out = np.full(n_rows, self.bias)
        if len(block_rows):
            at = np.flatnonzero(np.append(True, block_rows[1:] != block_rows[:-1]))
            out[block_rows[at]] = np.maximum.reduceat(self.passages(self.sums(block, term, len(block_rows)), block_rows), at)
        return out

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * scores + self.shift, -500, 500)))


def telling(df: np.ndarray, share: float, n: int, apart: float) -> np.ndarray:
    """Terms of at least LEAST texts whose count among toxic texts lies ``apart`` standard deviations from what the share of toxic texts lets expect."""
    both = df.sum(axis=0)
    spread = np.sqrt(np.maximum(both * share * (1 - share) * (1 - both / max(n, 1)), 1e-9))
    return (both >= LEAST) & (np.abs(df[1] - both * share) >= apart * spread)


def train(texts: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 15, rate: float = 0.2, decay: float = 0.1, apart: float = 3.0, seed: int = 5) -> Machine:
    """A machine from (label, block, term) of each text; a fifth of the texts only sets the line of its probabilities.

    Steps are those of adaptive gradients that begin at one, so a rare term moves little; weights and vectors decay.
    """
    n_terms = 1 << BITS
    df = np.zeros((2, n_terms))
    for y, _, term in texts:
        df[y][np.unique(term)] += 1
    share = float(np.mean([y for y, _, _ in texts])) if texts else 0.0
    known = telling(df, share, len(texts), apart)
    dice = np.random.default_rng(seed)
    vectors = np.where(known[:, None], dice.normal(0, 0.02, (n_terms, FACTORS)), 0.0)
    machine = Machine(-2.0, np.zeros(n_terms), vectors, known)
    if share in (0.0, 1.0):
        machine.slope, machine.shift = 0.0, -500.0 if share == 0 else 500.0
        return machine
    packed = []
    for y, block, term in texts:
        keep = known[term]
        packed.append((y, block[keep], term[keep], int(block[-1]) + 1 if len(block) else 0))
    order = dice.permutation(len(packed))
    fit, line = order[len(order) // 5 :], order[: len(order) // 5]
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    seen_w, seen_v, seen_b = np.ones(n_terms), np.ones((n_terms, FACTORS)), 1.0
    for _ in range(epochs):
        dice.shuffle(fit)
        for at in range(0, len(fit), 64):
            own = [packed[i] for i in fit[at : at + 64]]
            block, term, rows = _together(own)
            if not len(rows):
                continue
            sums = machine.sums(block, term, len(rows))
            scores = machine.passages(sums, rows)
            begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            size = np.diff(np.append(begin, len(rows)))
            best = np.array([b + int(np.argmax(scores[b : b + n])) for b, n in zip(begin, size, strict=True)])
            y = np.array([own[r][0] for r in rows[begin]])
            gap = (1 / (1 + np.exp(-np.clip(scores[best], -30, 30))) - y) * np.where(y == 1, weigh[1], weigh[0])
            pull = np.zeros(len(rows))
            total, share_of = np.zeros((len(rows), FACTORS)), np.zeros(len(rows))
            for b, g, end in zip(best, gap, begin + size, strict=True):
                last = min(b + 2, end)
                pull[b:last], total[b:last], share_of[b:last] = g, sums[b:last, 3:].sum(axis=0), 1 / max(1.0, sums[b:last, 2].sum())
            use = pull[block] != 0
            block, term = block[use], term[use]
            which, back = np.unique(term, return_inverse=True)
            g = pull[block]
            grad_w = np.bincount(back, g, len(which)) + decay * machine.weights[which]
            each = (g * share_of[block])[:, None] * (total[block] - machine.vectors[term])
            grad_v = np.column_stack([np.bincount(back, each[:, f], len(which)) for f in range(FACTORS)]) + decay * machine.vectors[which]
            seen_w[which] += grad_w**2
            seen_v[which] += grad_v**2
            seen_b += gap.sum() ** 2
            machine.weights[which] -= rate * grad_w / np.sqrt(seen_w[which])
            machine.vectors[which] -= rate / 2 * grad_v / np.sqrt(seen_v[which])
            machine.bias -= rate * gap.sum() / np.sqrt(seen_b)
    own = [packed[i] for i in line]
    block, term, rows = _together(own)
    _fit_line(machine, machine.rows(block, term, rows, len(own)), np.array([y for y, *_ in own], float))
    return machine


def _together(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, terms and rows of blocks of several texts."""
    before = np.cumsum([0, *[n for *_, n in texts]])
    block = [b + at for (_, b, _, _), at in zip(texts, before, strict=False)]
    return np.concatenate(block), np.concatenate([t for _, _, t, _ in texts]), np.repeat(np.arange(len(texts)), np.diff(before))


def _fit_line(machine: Machine, scores: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the log-odds by Newton steps, with a pull to slope 1 and a pseudo-count, so that few or parted texts still give a line."""
    if len(set(y)) < 2:
        return
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([scores, np.ones(len(y))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - target) + 0.01 * (b - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        b = b - np.linalg.solve(curve, grad)
    if b[0] > 0:
        machine.slope, machine.shift = float(b[0]), float(b[1])


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are not learned from: crc32 of the decimal id leaves 1 by 3; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: tuple[int, int], sample_bytes: int, text_bytes: int) -> DataFrame:
    """(hash, toxic, text): distinct labelled texts of rows that may be learned from, some ``sample`` of each label by the size of their hash.

    The bound of the hash follows from counts over all labelled rows. An id with several labels, and a text with several ids, is toxic if any says so.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).where(~held_out(F.col("id")) & (F.octet_length("text") <= text_bytes)).withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    narrow = rows.select("id", "hash", F.octet_length("text").alias("size")).join(marks, "id").groupBy("hash").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size"))
    narrow = materialize(narrow, "marks")
    found = {r["toxic"]: (r["n"], r["size"]) for r in narrow.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}  # two rows
    bound = F.lit(-1).cast("long")
    for label, (n, size) in found.items():
        share = min(1.0, sample[label] / n, sample_bytes / max(size, 1))
        bound = F.when(F.col("toxic") == label, F.lit(min(int(share * (1 << 63)), (1 << 63) - 1))).otherwise(bound)
    chosen = materialize(narrow.where(F.col("hash") <= bound).select("hash", "toxic"), "chosen")
    few = chosen.count() <= 4 * sum(sample)  # about sum(sample) at most, by the bound; more only if hashes crowd
    small = F.broadcast(chosen) if few else chosen
    out = materialize(rows.join(small.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.max("text").alias("text")).join(small, "hash"), "sample")
    release(narrow, chosen)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES, text_bytes: int = TEXT_BYTES) -> Machine:
    """A machine trained on a bounded sample of the labelled rows that are not held out; labels has doc_id and toxic."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            out = []
            for i in range(len(batch)):
                for _, raw, offsets in text_slices(pc.utf8_lower(batch.column(2).slice(i, 1)), TEXT_BYTES * 4):
                    block, term, _ = block_terms(hasher, raw, offsets)
                    out.append((block.astype(np.int32).tobytes(), term.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b for b, _ in out], pa.binary()), pa.array([t for _, t in out], pa.binary())], ["hash", "toxic", "block", "term"])

    rows = training_sample(docs, labels, id_col, text_col, sample, sample_bytes, text_bytes)
    got = rows.select("hash", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(terms, "hash long, toxic int, block binary, term binary").collect()  # bounded by sample and sample_bytes
    release(rows)
    got.sort(key=lambda r: r["hash"])
    return train([(r["toxic"], np.frombuffer(r["block"], np.int32).astype(np.int64), np.frombuffer(r["term"], np.int32).astype(np.int64)) for r in got])


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id_col, held_out, score, predicted) of each row; predicted is 1 from the threshold on. A null or empty text scores as one without words."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # 2^BITS terms, whatever the tables hold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = WordHasher(), model.value
        for batch in batches:
            for at, raw, offsets in text_slices(pc.utf8_lower(batch.column(1))):
                block, term, block_rows = block_terms(hasher, raw, offsets, own.known)
                scores = own.probability(own.rows(block, term, block_rows, len(offsets) - 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(scores)), pa.array(scores)], ["id", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **limits) -> DataFrame:
    """(id_col, held_out, score, predicted), one row per row of docs, by a machine trained on the labelled rows that are not held out.

    Only the text makes a score, so copies score alike, and letter case does not count. Null and empty texts score as texts without words. Rows of one
    id each have their own score; a null id is not held out and has no label. Labels that are null, or of an id that docs lacks, teach nothing; without
    toxic labels all scores are next to 0, with toxic ones alone next to 1. An empty table gives no rows; further columns play no part. limits are those of fit().
    """
    return score_texts(docs, fit(docs, labels, id_col, text_col, **limits), id_col, text_col, threshold)
