"""SentencePiece encoding and decoding: a shared-prefix Viterbi pass over the marked words of many texts.

A marked word is a run of space marks with the characters after it; no piece crosses the end of one. The distinct words of a batch are
sorted, which is a depth-first walk of their trie: the forward state of every prefix that two neighbours share is kept, not computed again.
For a unigram vocabulary the state is the best score and its last piece. For a byte-pair vocabulary, whose pieces have merge ranks
instead of log probabilities, the state is the only last piece that agrees with the merges, so the result is that of the merges themselves.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tidewatch.llm.common import WordHasher, mix, text_slices

MARK = "▁"
#: How far an unknown character scores below the worst piece of a unigram vocabulary.
UNKNOWN_PENALTY = 10.0
#: Entries of the tables of known words and of piece pairs that a task holds. A full table of words becomes the older one, from which words that come
#: again are taken over, so frequent words stay; a full table of pairs is emptied.
KNOWN, PAIRS = 3 << 16, 1 << 18
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20


class Pieces:
    """A vocabulary: rows of (id, piece, score, kind), kind one of normal, byte, unknown, control."""

    def __init__(self, rows: list[tuple[int, str, float, str]], kind: str, dummy_prefix: bool = True) -> None:
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"no vocabulary of kind {kind}")
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.ids = {piece: i for i, piece, _, k in rows if k == "normal"}
        self.scores = {piece: score for _, piece, score, k in rows if k == "normal"}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece crosses the end of a marked word")
        self.bytes = {int(piece[3:5], 16): i for i, piece, _, k in rows if k == "byte"}
        self.unknown = next((i for i, _, _, k in rows if k == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        table = {i: piece.replace(MARK, " ").encode() if k == "normal" else bytes([int(piece[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unknown" else b"" for i, piece, _, k in rows}
        self.texts = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Pieces that their own merges make, and by their last three, else two, characters their sizes, largest first.
        self.whole = {p for p in self.ids if self.merged(p) == [p]} if kind == "bpe" else set()
        ends: dict[str, set[int]] = {}
        for piece in self.whole:
            if len(piece) >= 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        short = {tail: tuple(sorted(sizes | {1}, reverse=True)) for tail, sizes in ends.items() if len(tail) == 2}
        self.sizes = short | {tail: tuple(sorted(sizes | set(short.get(tail[1:], ())) | {1}, reverse=True)) for tail, sizes in ends.items() if len(tail) == 3}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, symbols: str) -> list[str]:
        """The byte-pair pieces of a short string, merge by merge: best score first, then leftmost."""
        parts = list(symbols)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, before: str, piece: str) -> bool:
        """Whether the merges of before + piece leave exactly these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[before, piece] = self.merged(before + piece) == [before, piece]
        return found

    def _best(self, word: str, shared: int, last: list, best: list) -> None:
        """Unigram forward states of word beyond the first ``shared`` characters."""
        for end in range(shared + 1, len(word) + 1):
            top, choice = -np.inf, None
            for at in range(max(0, end - self.longest), end):
                score = self.scores.get(word[at:end], self.floor if at == end - 1 else None)
                if score is not None and best[at] + score > top:
                    top, choice = best[at] + score, word[at:end]
            last.append(choice)
            best.append(top)

    def _agreed(self, word: str, shared: int, last: list) -> None:
        """The same for merge ranks: of the pieces that end here one agrees with the merges of what is before it."""
        whole, sizes, pairs, one, append = self.whole, self.sizes, self.pairs, (1,), last.append
        for end in range(shared + 1, len(word) + 1):
            at = end - 3 if end > 3 else 0
            for size in sizes.get(word[at:end]) or sizes.get(word[at + 1 : end], one):
                if size > end:
                    continue
                piece = word[end - size : end]
                if size > 3 and piece not in whole:
                    continue
                before = last[end - size]
                if before:
                    agrees = pairs.get((before, piece))
                    if not (self._follows(before, piece) if agrees is None else agrees):
                        continue
                append(piece)
                break
            else:
                raise ValueError("merge ranks are not consistent")

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each marked word, as native unsigned 32-bit numbers."""
        new = sorted({w for w in words if w not in self.known})
        if len(self.known) + len(new) > KNOWN:
            self.known, self.older = {}, self.known
            new = sorted(set(words))
        if self.older:
            again = {w: self.older[w] for w in new if w in self.older}
            self.known.update(again)
            new = [w for w in new if w not in again]
        path, last, best = "", [""], [0.0]
        for word in new:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            if self.kind == "bpe":
                self._agreed(word, shared, last)
            else:
                self._best(word, shared, last, best)
            path, ids, at = word, [], len(word)
            while at:
                piece = last[at]
                at -= len(piece)
                i = self.ids.get(piece)
                if i is not None:
                    ids.append(i)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(piece.encode("utf-8", "replace")))
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            self.known[word] = array("I", ids[::-1]).tobytes()
        return [self.known[w] for w in words]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of ids[bounds[i] : bounds[i + 1]] for each i; ids without a piece give nothing."""
        known = ids < len(self.lengths)
        own = np.where(known, ids, 0)
        sizes = np.where(known, self.lengths[own], 0)
        ends = np.cumsum(sizes)
        blob = self.flat[np.repeat(self.begins[own] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edges = np.concatenate([[0], ends])[bounds].tolist()
        skip = 1 if self.dummy_prefix else 0
        return [blob[a + skip if blob[a : a + 1] == b" " and a < b else a : b].decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decoded(ids, np.array([0, len(ids)]))[0]


def load_pieces(model_path: str, kind: str, dummy_prefix: bool = True) -> Pieces:
    """The vocabulary of a model file; kind (bpe or unigram) and the dummy prefix are those it was trained with."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    kinds = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"
    return Pieces([(i, model.id_to_piece(i), model.get_score(i), kinds(i)) for i in range(model.get_piece_size())], kind, dummy_prefix)


def encoded_slice(pieces: Pieces, raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds of each text's ids)."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins = raw == 32
    begins[1:] &= raw[:-1] != 32
    begins[first] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(raw))
    hasher._powers(len(raw))
    own = hasher._hashes(raw, start, end)
    opens = np.isin(start, first, assume_unique=True)
    own = np.where(opens, mix(own + np.uint64(1)), own)
    _, sample, which = np.unique(own, return_index=True, return_inverse=True)
    blob = raw.tobytes()
    words = [(MARK if pieces.dummy_prefix and opens[i] else "") + blob[start[i] : end[i]].decode("utf-8", "replace").replace(" ", MARK) for i in sample]
    ids = pieces.words(words)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
    count = sizes[which]
    where = np.repeat(begin[which], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row = np.searchsorted(offsets, start, "right") - 1
    per_row = np.bincount(row, weights=count, minlength=n).astype(np.int64)
    return flat[where], np.concatenate([[0], np.cumsum(per_row)])


def encode_texts(docs: DataFrame, pieces, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with out_col: the ids of each whole text as little-endian unsigned 32-bit numbers.

    pieces is a broadcast of a vocabulary (its size is fixed). A null or empty text has no ids; a mark written in a text counts as a space.
    Rows come back one for one, repeated or with null ids too; out_col replaces a column of this name. Empty tables pass through.
    """
    rest = docs.drop(out_col) if out_col != text_col else docs
    names, place = rest.columns, rest.columns.index(text_col)
    schema = StructType([*rest.schema.fields, StructField(out_col, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = pieces.value, WordHasher()
        for batch in batches:
            texts = batch.column(place)
            if pc.any(pc.match_substring(texts, MARK)).as_py():
                texts = pc.replace_substring(texts, MARK, " ")
            for first, raw, offsets in text_slices(texts, SLICE):
                ids, bounds = encoded_slice(table, raw, offsets, hasher)
                blobs = pa.array([ids[bounds[i] : bounds[i + 1]].astype("<u4").tobytes() for i in range(len(bounds) - 1)], pa.binary())
                part = batch.slice(first, len(blobs))
                yield pa.RecordBatch.from_arrays([*part.columns, blobs], [*names, out_col])

    return rest.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, pieces, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """encoded with out_col: the text of the ids; null ids give a null text, ids without a piece nothing."""
    rest = encoded.drop(out_col)
    names, place = rest.columns, rest.columns.index(ids_col)
    schema = StructType([*rest.schema.fields, StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        for batch in batches:
            blobs = batch.column(place).to_pylist()
            sizes = np.array([len(b or b"") // 4 for b in blobs], np.int64)
            at = 0
            while at < len(blobs):  # some MB of text at a time
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE, "right")))
                ids = np.frombuffer(b"".join(b or b"" for b in blobs[at:end]), "<u4").astype(np.int64)
                texts = table.decoded(ids, np.concatenate([[0], np.cumsum(sizes[at:end])]))
                texts = [None if b is None else t for b, t in zip(blobs[at:end], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, pa.array(texts, pa.string())], [*names, out_col])
                at = end

    return rest.mapInArrow(run, schema)


def checksum(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """encoded with n_ids and ids_crc32 (unsigned)."""
    own = F.coalesce(F.col(ids_col), F.lit(b""))
    return encoded.withColumns({"n_ids": (F.octet_length(own) / 4).cast("long"), "ids_crc32": F.crc32(own)})


def crc_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
