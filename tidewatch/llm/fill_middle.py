"""Fill-in-the-middle training texts: a text is cut at two unit ends and its middle moved to the end behind marks."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a line with its end.
LINE = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def seeds(key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of a key."""
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    return array("q", (m.end() for m in unit.finditer(text)))


def cut(text: str, ends: array, h1: int, h2: int) -> tuple[int, int]:
    """Ends of prefix and middle, in code points."""
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return ends[low - 1] if low else 0, ends[high - 1] if high else 0


def arranged(text: str, begin: int, end: int, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text with its middle text[begin:end] last."""
    prefix, suffix, middle = marks
    if form == "psm":
        return f"{prefix}{text[:begin]}{suffix}{text[end:]}{middle}{text[begin:end]}"
    return f"{suffix}{text[end:]}{prefix}{text[:begin]}{middle}{text[begin:end]}"


def rebuilt(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that arranged() was given, from its output and form alone; a plain output is the text."""
    prefix, suffix, middle = marks
    if form == "plain":
        return output
    first, second = (prefix, suffix) if form == "psm" else (suffix, prefix)
    at_second = output.index(second, len(first))
    at_middle = output.index(middle, at_second + len(second))
    one, two, three = output[len(first) : at_second], output[at_second + len(second) : at_middle], output[at_middle + len(middle) :]
    return one + three + two if form == "psm" else two + three + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256), one row per row of docs.

    A text of n units is cut after two unit counts drawn from ``seed:id``; percent of the texts are arranged, spm_percent of these with the suffix
    first. Form is plain, the output then the text and its cuts null, where the text is empty or null (an empty text), holds a mark, or isn't drawn.
    Rows of one id draw alike, each by its own text; a null id draws as the empty one. Cuts never split a unit; what no unit covers stays with the
    unit after it. An empty table gives no rows; further columns play no part. Batches are what Arrow sends (spark.sql.execution.arrow.*); beside one
    batch of texts and one of outputs a task holds the unit ends of one text.
    """

    @F.pandas_udf(_MADE)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for ids, texts in batches:
            rows = []
            for key, text in zip(ids, texts, strict=True):
                text = text or ""
                ends = unit_ends(text, pattern)
                h1, h2, h3, h4 = seeds(f"{seed}:{key or ''}")
                if not text or h3 % 100 >= percent or any(m in text for m in marks):
                    whole = _digest(text)
                    rows.append((len(ends), "plain", None, None, text, whole, whole))
                    continue
                begin, end = cut(text, ends, h1, h2)
                form = "spm" if h4 % 100 < spm_percent else "psm"
                output = arranged(text, begin, end, form, marks)
                rows.append((len(ends), form, begin, end - begin, output, _digest(output), _digest(rebuilt(output, form, marks))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MADE.split(", ")])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    own = docs.select(F.col(id_col).alias(id_col), made(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("own"))
    return own.select(id_col, "own.*")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The original texts of a column of outputs; null where output or form is null."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rebuilt(o, f, marks) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)
