"""Quality rules from tokenizer fertility: characters per token, byte-fallback share and token entropy, with bands per script."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, mix, text_slices
from tidewatch.llm.packing import ByteBpe

#: Code point ranges of the scripts that have bands of their own; a text's script is that of most of its letters.
SCRIPTS = {
    "latin": (0x41, 0x24F),
    "greek": (0x370, 0x3FF),
    "cyrillic": (0x400, 0x52F),
    "hebrew": (0x590, 0x5FF),
    "arabic": (0x600, 0x6FF),
    "devanagari": (0x900, 0x97F),
    "kana": (0x3040, 0x30FF),
    "han": (0x4E00, 0x9FFF),
    "hangul": (0xAC00, 0xD7AF),
}
#: By script and place of the vocabulary, the least and most characters per token. Measured on clean text of each script and on its shuffled letters: outside
#: Latin the English vocabulary does not tell them apart, the multilingual one does where words are written apart, and the least lies between them. In Latin
#: the least is under invented languages, which lie near shuffled letters; it rejects encoded data and text in a wrong encoding.
BANDS = {
    "latin": {0: (1.45, 9.0), 1: (1.45, 9.0)},
    "greek": {1: (1.65, 4.5)},
    "cyrillic": {1: (2.3, 7.0)},
    "hebrew": {1: (1.57, 4.0)},
    "arabic": {1: (1.68, 4.5)},
    "devanagari": {1: (0.85, 3.0)},
    "kana": {1: (0.8, 3.0)},
    "han": {1: (0.7, 2.5)},
    "hangul": {1: (1.15, 3.5)},
    "none": {0: (0.9, 9.0), 1: (0.9, 9.0)},
}
#: Most share of bytes that the piece vocabulary can write as byte pieces only (clean text of any script: at most 0.05), and least entropy share.
FALLBACK, ENTROPY = 0.12, 0.45
#: Bands widen by this over the square root of the number of tokens, as measures of short texts scatter more.
WIDENING = 1.5


def base_counts(raw: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    rows, hashed, start, end = hasher.words(raw, offsets, lower=False)
    out = {"n_words": np.bincount(rows, minlength=n)}
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(rows, weights=chars[end] - chars[start], minlength=n).astype(np.int64)
    symbol = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8)))])
    out["n_symbols"] = symbol[offsets[1:]] - symbol[offsets[:-1]]
    l_rows, l_hash, l_start, l_end = hasher.spans(raw, offsets, 10)
    words_before = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    full = words_before[1] > words_before[0]
    l_rows, l_hash = l_rows[full], l_hash[full]
    order = np.lexsort((l_hash, l_rows))
    same = (l_rows[order][1:] == l_rows[order][:-1]) & (l_hash[order][1:] == l_hash[order][:-1])
    out["n_dup_lines"] = np.bincount(l_rows[order][1:][same], minlength=n)
    repeat = np.zeros(len(rows), bool)
    if len(rows) >= 3:
        tri = mix(mix(hashed[:-2] * np.uint64(3) + hashed[1:-1]) * np.uint64(5) + hashed[2:])
        at = np.flatnonzero(rows[:-2] == rows[2:])
        order = at[np.lexsort((tri[at], rows[at]))]
        same = (rows[order][1:] == rows[order][:-1]) & (tri[order][1:] == tri[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for step in range(3):
            repeat[order[twice] + step] = True
    out["n_repeat_words"] = np.bincount(rows[repeat], minlength=n)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def script_of(points: np.ndarray) -> str:
    """The script of most letters, none if there are none."""
    counts = {name: int(((points >= lo) & (points <= hi)).sum()) for name, (lo, hi) in SCRIPTS.items()}
    counts["latin"] -= int(((points >= 0x5B) & (points <= 0x60)).sum() + ((points >= 0x7B) & (points <= 0xBF)).sum())
    best = max(counts, key=counts.get)
    return best if counts[best] > 0 else "none"


def fallback_share(points: np.ndarray, covered: np.ndarray) -> float:
    """The share of a text's bytes in characters without a piece; white space has one."""
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return float(size[~covered[points]].sum() / max(1, size.sum()))


def covered_points(pieces: list[str]) -> np.ndarray:
    """Which code points a piece vocabulary writes without byte pieces: those that are a piece, and white space."""
    covered = np.zeros(0x110000, bool)
    covered[[ord(p) for p in pieces if len(p) == 1]] = True
    covered[[9, 10, 11, 12, 13, 32]] = True
    return covered


def judged(text: str, models: list[ByteBpe], covered: np.ndarray, bands: dict = BANDS) -> tuple[bool, str, tuple[float, float, float]]:
    """(kept, script, (characters per token, byte-fallback share, entropy as a share of log2 of the tokens)) of a text that passed the base rules.

    It is kept if one of its script's vocabularies finds all three within the bands; the measures are of the last vocabulary tried.
    """
    points = code_points(text)
    script = script_of(points)
    fallback = fallback_share(points, covered)
    found = (float("nan"), fallback, float("nan"))
    for place, (low, high) in bands[script].items():
        ids = np.array(models[place].ids(text), np.int64)
        p = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        found = len(points) / max(1, len(ids)), fallback, float(-(p * np.log2(p)).sum() / np.log2(max(2, len(ids))))
        slack = WIDENING / np.sqrt(max(1, len(ids)))
        if low * (1 - slack) <= found[0] <= high * (1 + slack) and fallback <= FALLBACK + slack / 4 and found[2] >= ENTROPY * (1 - slack):
            return True, script, found
    return False, script, found


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "fallback_share", "entropy_share"]


def _models(vocabularies: list) -> list[ByteBpe]:
    return [ByteBpe(v.value[0], None, v.value[2]) for v in vocabularies]


def _verdicts(texts: pa.Array, models: list[ByteBpe], covered: np.ndarray, hasher: WordHasher, bands: dict) -> Iterator[tuple]:
    """(first row, base counts, base_failed, kept, scripts, measures) of each slice of texts."""
    for first, raw, offsets in text_slices(texts):
        n = len(offsets) - 1
        base = base_counts(raw, offsets, hasher)
        failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
        kept, scripts, values = ~failed, [], np.full((3, n), np.nan)
        for i in range(n):
            text = texts[first + i].as_py() or ""
            if failed[i]:
                scripts.append(script_of(code_points(text)))
                continue
            kept[i], script, values[:, i] = judged(text, models, covered, bands)
            scripts.append(script)
        yield first, base, failed, kept, scripts, values


def fertility_rules(docs: DataFrame, vocabularies: list, pieces, id_col: str = "doc_id", text_col: str = "text", bands: dict = BANDS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, chars_per_token, fallback_share, entropy_share).

    base_failed: n_words < 50 or 100 n_repeat_words > 50 n_words. A text that passes is rejected if every vocabulary of its script puts it
    outside the bands; vocabularies are broadcasts of the English and the multilingual byte-level one, pieces one of the piece vocabulary's list of
    pieces, all of fixed size. Measures are those of the last vocabulary tried, null where base_failed. A null text has no words and fails; rows are returned one for one, with repeated or null ids too. An empty table gives an empty result; further columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, covered, hasher = _models(vocabularies), covered_points(pieces.value), WordHasher()
        for batch in batches:
            for first, base, failed, kept, scripts, values in _verdicts(batch.column(1), models, covered, hasher, bands):
                arrays = [batch.column(0).slice(first, len(kept)), *(pa.array(base[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(scripts), *(pa.array(v, from_pandas=True) for v in values)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *COUNTS, "base_failed", "kept", "script", *MEASURES])

    schema = "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, script string, " + ", ".join(f"{c} double" for c in MEASURES)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_fertile(docs: DataFrame, vocabularies: list, pieces, text_col: str = "text", bands: dict = BANDS) -> DataFrame:
    """The rows of docs that fertility_rules keeps, with all their columns and without a shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, covered, hasher = _models(vocabularies), covered_points(pieces.value), WordHasher()
        for batch in batches:
            for first, _, _, kept, _, _ in _verdicts(batch.column(place), models, covered, hasher, bands):
                yield batch.slice(first, len(kept)).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
