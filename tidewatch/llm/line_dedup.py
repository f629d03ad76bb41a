"""Line de-duplication over a store of levelled sorted runs of line hashes. DataFrame operations only.

Batches of documents come by falling id. A batch's lines are anti-joined with the runs: those that no run holds make a new run of
(h1, h2, n_docs, keeper), and their keeper, the largest document that holds them, is settled; those that a run holds only add to
its count and go to the hits (h1, h2, n_docs). So each line is in one run, and runs merge without aggregation: ``fanout`` runs of a level
become one of the next, and a store of b batches has O(fanout log b) runs. Runs and hits are bucketed and sorted by hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_prefix, let, materialize, materialize_sorted, release

#: The white space that a key loses at both ends: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["h1", "h2"]
#: Lines in one batch.
BATCH_LINES = 500_000_000
#: A line with more than this share of all line rows is looked up in a broadcast table, of 1000 rows at most.
HOT_SHARE = 0.001


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class RunStore:
    """The levels of runs. Every run is a table in the shared folder; the object holds only their places."""

    def __init__(self, fanout: int = 4) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.hits: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of batch(h1, h2, ...) whose line no run holds: one merge anti-join a run."""
        for run in self.runs():
            batch = batch.join(run.select(*KEYS), KEYS, "left_anti")
        return batch

    def seen(self, batch: DataFrame) -> DataFrame | None:
        """The other rows of batch; None if there are no runs."""
        parts = [batch.join(run.select(*KEYS), KEYS, "left_semi") for run in self.runs()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def add(self, batch: DataFrame) -> None:
        """Adds the lines of batch(doc_id, h1, h2). Its ids are smaller than those of all batches before."""
        counts = batch.where("doc_id is not null").select("doc_id", *KEYS).distinct().groupBy(*KEYS).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        if not self.runs():
            self.levels[0].append(materialize_sorted(counts, "run", KEYS))
            return
        counts = materialize_sorted(counts, "batch", KEYS)
        self.hits.append(materialize_sorted(self.seen(counts).select(*KEYS, "n_docs"), "hits", KEYS))
        self.levels[0].append(materialize_sorted(self.unseen(counts), "run", KEYS))
        release(counts)
        self._compact()

    def _compact(self) -> None:
        if len(self.hits) >= self.fanout:
            old, self.hits = self.hits, [materialize_sorted(self._hits(), "hits", KEYS)]
            release(*old)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(materialize_sorted(reduce(DataFrame.unionByName, old), "run", KEYS))
            release(*old)
            level += 1

    def _hits(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.hits).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"))

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, keeper) of the lines that min_docs documents hold."""
        lines = reduce(DataFrame.unionByName, self.runs())
        if self.hits:
            more = self._hits().withColumnRenamed("n_docs", "more")
            lines = lines.join(more, KEYS, "left").withColumn("n_docs", F.col("n_docs") + F.coalesce("more", F.lit(0))).drop("more")
        return lines.where(F.col("n_docs") >= min_docs)

    def drop(self) -> None:
        release(*self.runs(), *self.hits)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, version, line, h1, h2) of the lines whose key has min_chars code points; version tells texts of one id apart."""
    key = lambda l: line_key(l)
    items = F.transform(text_lines(F.col(text_col)), lambda l, i: F.struct(i.alias("line"), key(l).alias("key")))
    items = F.filter(items, lambda x: F.length(x["key"]) >= min_chars)
    items = F.transform(items, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.explode(items).alias("x"))
    return found.select("doc_id", "version", "x.line", "x.h1", "x.h2")


def _batches(lines: DataFrame, batch_lines: int) -> tuple[int, list[Column]]:
    """The number of rows of lines, and the conditions of its batches by falling doc_id, each of about batch_lines rows."""
    total = lines.count()
    n = max(2, -(-total // batch_lines))
    cuts = lines.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"]
    edges = [None, *sorted(set(cuts or [])), None]
    parts = [(F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return total, parts[::-1]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batch_lines: int = BATCH_LINES, fanout: int = 4) -> DataFrame:
    """docs with (n_lines, n_dropped, kept_text): lines found in min_docs documents stay only in the one with the largest id.

    A line's key is the line without white space at its ends, A-Z lower-cased. A null or empty text is one empty line. Rows of the same
    id are one document and all returned; a null id is never counted and loses nothing. Empty tables and further columns, whatever their
    names, pass through (n_lines, n_dropped, kept_text replace columns of these names).
    """
    lines = materialize(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    total, batches = _batches(lines, batch_lines)
    store = RunStore(fanout)
    for part in batches:
        store.add(lines.where(part))
    common = materialize_sorted(store.repeated(min_docs), "common", KEYS)
    store.drop()
    hot = F.col("n_docs") > max(1000, HOT_SHARE * total)
    often = F.broadcast(common.where(hot).select(*KEYS, "keeper"))  # each with a thousandth of all rows or more: 1000 lines at most
    marked = lines.join(often, KEYS, "left")
    found = marked.where("keeper is not null").unionByName(marked.where("keeper is null").drop("keeper").join(common.where(~hot).select(*KEYS, "keeper"), KEYS))
    gone = found.where("doc_id <> keeper").select("doc_id", "version", "line").distinct().groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    gone = materialize(gone, "gone")
    release(lines, common)

    own = free_prefix(docs)  # gone grows with the documents: never broadcast, whatever its size
    gone = gone.toDF(f"{own}id", f"{own}version", f"{own}gone")
    row = docs.withColumns({f"{own}key": F.col(id_col).cast("long"), f"{own}hash": F.xxhash64(text_col)})
    out = row.join(gone.hint("merge"), (F.col(f"{own}key") == F.col(f"{own}id")) & (F.col(f"{own}hash") == F.col(f"{own}version")), "left")
    left_out = F.col(f"{own}gone")
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), left_out)
    rest = let(text_lines(F.col(text_col)), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n"))
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_lines = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1
    text = F.when(left_out.isNull(), plain).otherwise(rest)
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.when(left_out.isNull(), 0).otherwise(F.size(left_out)).cast("long"), "kept_text": text})
    return out.drop(*(f"{own}{c}" for c in ("key", "hash", "gone", "id", "version")))
