"""N-gram Jaccard join: every pair of texts whose shingle sets are alike, through prefix filtering and a prefix tree.

All sets follow one global order: rare shingles by hash, then frequent ones by hash. Two sets of similarity t share one of their first
n - ceil(t n) + 1 shingles in any such order. The rare part of a prefix nearly always lies among the lowest hashes, so the shingles below one
hash bound are counted first, exactly and over all sets; the few sets whose prefix reaches further have their other shingles counted as well.
A rare shingle is in at most ``FREQUENT`` prefixes, and the sets that share one make pairs; a pair is left out if the shingles that its
prefixes share and what lies beyond them can't reach the threshold. Sets that share a frequent shingle meet at the one of them with
the fewest rare shingles (a hub), and only pairs that the links so far don't connect are compared besides. Surviving pairs are compared in a
prefix tree: the candidates of one set are walked in order, share the overlaps of their common beginnings, and subtrees whose remaining length
can't reach the threshold are cut.

Sets hold 48-bit hashes of shingles and are named by a 64-bit hash of the whole set: a text of a million shingles has a miscounted one in
about 1 of 500 cases, and two of a billion different sets fall together in about 1 of 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WordHasher, binary_column, free_prefix, materialize, mix, release, shingles, text_slices
from tidewatch.llm.components import connected_components

#: A shingle that more sets hold comes late in the global order.
FREQUENT = 16
#: Bits of the bitmap that keeps sets nobody asks for from being shuffled: 8 MB, whatever the input; a full one costs time only.
BITS = 26
#: The share of all hashes that is counted first, as a multiple of the prefix's share of a set.
AHEAD = 1.5
#: Shingles that a task gathers before it deals them out, and that one task counts.
GATHERED, COUNTED = 1_000_000, 700_000
#: Candidates of one set that one task compares.
CELL = 256

_MASK = np.uint64((1 << 48) - 1)


def pack(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def unpack(blob: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = blob.reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def required(size_a, size_b, percent: int):
    """Least intersection for a Jaccard similarity of percent / 100."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, bound: int) -> DataFrame:
    """(id, sig, n, low, tokens): the distinct shingles of each whole text, as sorted 6-byte hashes of which low are under bound; sig stands for the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0)
            for first, raw, offsets in text_slices(batch.column(1)):
                n_rows = len(offsets) - 1
                rows, hashed, _, _ = hasher.words(raw, offsets)
                rows, tokens = shingles(rows, hashed, n_rows, size, short=True)
                tokens &= _MASK
                order = np.lexsort((tokens, rows))
                rows, tokens = rows[order], tokens[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
                rows, tokens = rows[new], tokens[new]
                counts = np.bincount(rows, minlength=n_rows)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(0x5851F42D4C957F2D)))])
                sig = mix(total[bounds[1:]] - total[bounds[:-1]] + counts.astype(np.uint64)).view(np.int64)
                low = np.bincount(rows[tokens < np.uint64(bound)], minlength=n_rows)
                numbers = [pa.array(x.astype(np.int32)) for x in (counts, low)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n_rows), pa.array(sig), *numbers, binary_column(pack(tokens), bounds)], ["id", "sig", "n", "low", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, sig long, n int, low int, tokens binary")


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(sig, n, low, row of each token, tokens) of a batch of sets, in slices."""
    column = batch.column(batch.schema.get_field_index("tokens")).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    sig, n, low = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("sig", "n", "low"))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (3 << 20), "right")) - 1)
        yield sig[at:end], n[at:end], low[at:end], np.repeat(np.arange(end - at), n[at:end]), unpack(raw[offsets[at] : offsets[end]])
        at = end


def _prefix(n):
    """SQL of the length of the prefix of a set of n; {percent} stays open."""
    return f"({n} - ({{percent}} * {n} + 99) div 100 + 1)"


_ENTRY = ["tok", "sig", "n", "low", "pos"]
_DEALT = "part int, frequent boolean, tok binary, pos binary, owner binary, sig binary, n binary, low binary"


def _dealt(sets: DataFrame, bound: int, beyond: bool, partitions: int) -> DataFrame:
    """The shingles under the hash bound, or beyond it, of each set, gathered by partition of the shingle into columns of numbers.

    A row holds for each of its shingles the place in the set and the number of the set in the row's own list (sig, n, low). Equal sets that meet in a
    task are dealt once. A shingle that is frequent among the sets of one task is marked so: its entries only go back to their sets, and its
    partition learns of it once, as a single entry of a set that is none (n = 0).
    """

    def flush(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tok, sig, n, low, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(tok, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], tok[order][1:] != tok[order][:-1], [True]]))
        often = np.diff(edge) > FREQUENT
        hot = np.zeros(len(tok), bool)
        hot[order] = np.repeat(often, np.diff(edge))
        told = tok[order][edge[:-1][often]]
        part = (tok % np.uint64(partitions)).astype(np.int32)
        part[hot] = (sig[hot].view(np.uint64) % np.uint64(partitions)).astype(np.int32)
        part = np.concatenate([part, (told % np.uint64(partitions)).astype(np.int32)])
        nothing = np.zeros(len(told), np.int32)
        tok, sig, n, low, pos = (np.concatenate(x) for x in ((tok, told), (sig, nothing.astype(np.int64)), (n, nothing), (low, nothing), (pos, nothing)))
        key = part * 2 + np.concatenate([hot, np.zeros(len(told), bool)])
        order = np.argsort(key, kind="stable")  # within a row, sets stay together
        key, sig = key[order], sig[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        other = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
        owner = np.cumsum(other) - 1
        own_edge = np.append(owner[edge[:-1]], owner[-1] + 1)
        owner -= np.repeat(own_edge[:-1], np.diff(edge))
        blobs = [binary_column(x, edge) for x in (pack(tok[order]), pos[order], owner.astype(np.int32))]
        blobs += [binary_column(x[other], own_edge) for x in (sig, n[order], low[order])]
        first = key[edge[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array((first // 2).astype(np.int32)), pa.array(first % 2 == 1), *blobs], ["part", "frequent", "tok", "pos", "owner", "sig", "n", "low"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for sig, n, low, rows, tokens in _rows_of(batch):
                chosen = np.zeros(len(sig), bool)
                chosen[np.unique(sig, return_index=True)[1]] = True
                pos = (np.arange(len(rows)) - (np.cumsum(n) - n)[rows]).astype(np.int32)
                keep = chosen[rows] & ((tokens >= np.uint64(bound)) == beyond)
                rows = rows[keep]
                parts.append([tokens[keep], sig[rows], n[rows], low[rows], pos[keep]])
                held += len(rows)
                if held >= GATHERED:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return sets.select("sig", "n", "low", "tokens").mapInArrow(run, _DEALT)


def _shared(dealt: DataFrame, partitions: int) -> DataFrame:
    """(tok, sig, n, low, pos, frequent) of every entry whose shingle at least two sets hold; a frequent one is held by more than FREQUENT."""

    def run(batches):
        known, parts = [], []
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i, frequent in enumerate(column["frequent"].to_pylist()):
                raw = {c: np.frombuffer(column[c][i].as_buffer(), np.uint8) for c in ("tok", "pos", "owner", "sig", "n", "low")}
                owner = raw["owner"].view(np.int32)
                rest = [raw["sig"].view(np.int64)[owner], raw["n"].view(np.int32)[owner], raw["low"].view(np.int32)[owner], raw["pos"].view(np.int32)]
                (known if frequent else parts).append([unpack(raw["tok"]), *rest])
        if known:
            tok, *rest = (np.concatenate(x) for x in zip(*known, strict=True))
            yield from entries(tok, *rest, np.ones(len(tok), bool))
        if not parts:
            return
        tok, sig, n, low, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((sig, tok))
        tok, sig, n, low, pos = (x[order] for x in (tok, sig, n, low, pos))
        fresh = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])])  # equal sets of other tasks
        tok, sig, n, low, pos = (x[fresh] for x in (tok, sig, n, low, pos))
        edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]]))
        count = np.diff(edge)
        hot = np.repeat((count > FREQUENT) | (np.minimum.reduceat(n, edge[:-1]) == 0), count)
        keep = (hot | np.repeat(count > 1, count)) & (n > 0)
        yield from entries(*(x[keep] for x in (tok, sig, n, low, pos, hot)))

    def entries(tok, sig, n, low, pos, hot):
        for at in range(0, len(tok), 100_000):
            part = [pa.array(x[at : at + 100_000]) for x in (tok.view(np.int64), sig, n, low, pos, hot)]
            yield pa.RecordBatch.from_arrays(part, [*_ENTRY, "frequent"])

    return dealt.repartitionById(partitions, F.col("part")).mapInArrow(run, "tok long, sig long, n int, low int, pos int, frequent boolean")


def _held(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = (values & values.dtype.type((1 << BITS) - 1)).astype(np.int64)
    return ((bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)


def _bitmap(values: DataFrame) -> np.ndarray:
    """The low bits of the only column, a long, as one bitmap of 2 ** BITS bits."""
    cells = values.toDF("value").select(F.expr(f"value & {(1 << BITS) - 1}").alias("cell"))
    parts = cells.groupBy(F.expr("cell div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("cell % 32768")).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for part, bits in parts.collect():  # at most 2 ** BITS / 32768 rows of 4 KB
        out[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _only(sets: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """One copy of each set whose sig is in named."""
    wanted = materialize(nodes.join(named.distinct(), "sig").select("sig", F.col("first_id").alias("id")), "wanted")
    held = sets.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(F.expr("coalesce(id ^ shiftright(id, 26), 0)"))))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            yield batch.filter(pa.array(_held(held.value, ids ^ (ids >> 26))))

    near = sets.mapInArrow(run, sets.schema)
    # The ids have let in about one copy of each set; one shuffle by sig serves the join and the rest. The sets grow with the documents: no broadcast.
    found = near.join(wanted.select("sig").hint("merge"), "sig", "left_semi").dropDuplicates(["sig"])
    out = materialize(found.select("sig", "n", "low", "tokens"), "needed", "none")
    release(wanted)
    return out


def walk_tree(hub: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are alike to hub: the tree of the sets, depth first, with partial overlaps shared by common prefixes.

    A path is left as soon as its overlap and the remaining tokens of either side can't reach the required intersection.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    alike = np.zeros(len(sets), bool)
    path, shared, at = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0  # shared[d]: overlap of the first d tokens
    for i in order:
        own = sets[i]
        need = required(len(hub), len(own), percent)
        m = min(len(own), at)
        differs = np.flatnonzero(own[:m] != path[:m])
        depth = int(differs[0]) if len(differs) else m
        overlap = np.zeros(len(own) + 1, np.int64)
        overlap[: depth + 1] = shared[: depth + 1]
        while True:
            here = int(overlap[depth])
            left = len(hub) - int(np.searchsorted(hub, own[depth - 1], "right")) if depth else len(hub)
            if depth == len(own) or here + min(len(own) - depth, left) < need:
                break
            step = own[depth : depth + 128]
            place = np.searchsorted(hub, step)
            overlap[depth + 1 : depth + 1 + len(step)] = here + np.cumsum((place < len(hub)) & (hub[np.minimum(place, len(hub) - 1)] == step))
            depth += len(step)
        alike[i] = depth == len(own) and overlap[depth] >= need
        path, shared, at = own, overlap, depth
    return alike


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity holds. Each set a meets at most about CELL candidates in one group; a is sent once to each group."""

    def run(batches):
        hub = tokens = None
        for batch in batches:
            group, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            a, is_hub = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            blob = lambda i: unpack(np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8))  # noqa: E731, B023
            cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (group[1:] != group[:-1]) | is_hub[1:], [True]])) if len(a) else []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if is_hub[start]:
                    hub, tokens, start = (a[start], group[start]), blob(int(start)), start + 1
                if start == end:
                    continue
                assert hub == (a[start], group[start])
                alike = walk_tree(tokens, [blob(i) for i in range(start, end)], percent)
                if alike.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[start:end][alike]), pa.array(b[start:end][alike])], ["a", "b"])

    own = sets.select("sig", "tokens").hint("merge")  # grows with the documents: never broadcast, whatever its size
    groups = pairs.groupBy("a").agg(F.expr(f"(count(*) + {CELL - 1}) div {CELL}").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.expr("pmod(xxhash64(b), groups)").alias("cell"))
    hubs = dealt.select("a", "cell").distinct().join(own, F.col("a") == F.col("sig")).select("cell", F.col("a").alias("b"), "a", F.lit(True).alias("is_hub"), "tokens")
    others = dealt.join(own, F.col("b") == F.col("sig")).select("cell", "b", "a", F.lit(False).alias("is_hub"), "tokens")
    together = hubs.unionByName(others).repartition("a", "cell").sortWithinPartitions("a", "cell", F.desc("is_hub"))
    return together.mapInArrow(run, "a long, b long")


def _placed(entries: DataFrame, percent: int) -> DataFrame:
    """Entries with the number of frequent shingles of their set (late_ones), at, their place in the global order as far as it was counted, and p, the prefix's length.

    held is how many of the set's shingles came as shared, and most how many can be if only the low ones were counted: it has no more in common with any.
    """
    own = Window.partitionBy("sig")
    before = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("frequent").cast("int")
    once = entries.withColumn("last", F.lag("pos").over(own.orderBy("pos"))).where("last is null or last <> pos")  # equal sets of several tasks
    counted = once.withColumn("late_ones", F.sum(late).over(own)).withColumn("before", F.coalesce(F.sum(late).over(before), F.lit(0)))
    counted = counted.withColumns({"held": F.count("*").over(own).cast("int"), "most": F.expr("n - low") + F.sum(F.expr("cast(pos < low as int)")).over(own)})
    at = F.when(F.col("frequent"), F.expr("n - late_ones + before")).otherwise(F.expr("pos - before"))
    return counted.select("tok", "sig", "n", "low", "pos", "frequent", "late_ones", "held", F.col("most").cast("int").alias("most"), at.alias("at"), F.expr(_prefix("n").format(percent=percent)).alias("p"))


def _prefixes(all_sets: DataFrame, nodes: DataFrame, bound: int, percent: int) -> DataFrame:
    """(tok, sig, n, p, at, frequent, late, held, most): the shared shingles of every prefix; late is how many frequent ones the prefix holds.

    Sets whose prefixes hold frequent shingles were counted in full, so such a set has at most held shingles in common with another of them, and most with any.
    """

    def entries(sets: DataFrame, beyond: bool, total: int) -> DataFrame:
        partitions = total // COUNTED + 1
        return _shared(_dealt(sets, bound, beyond, partitions), partitions)

    total = nodes.agg(F.sum("low")).first()[0] or 0
    first = _placed(entries(all_sets, False, total), percent).withColumn("short", F.expr("low - late_ones < p and low < n or n - late_ones < p"))
    first = materialize(first.where("short or (not frequent and at < p)"), "placed")
    more = first.where("short").select("sig").unionByName(nodes.where(f"low < {_prefix('n').format(percent=percent)}").select("sig"))
    needed = _only(all_sets, nodes, more)
    total = needed.agg(F.sum(F.col("n") - F.col("low"))).first()[0] or 0
    whole = entries(needed, True, total).unionByName(first.where("short").select(*_ENTRY, "frequent"))
    columns = ["tok", "sig", "n", "p", "at", "frequent", "held", "most"]
    second = _placed(whole, percent).where("at < p").select(*columns, F.expr("greatest(0, p - n + late_ones)").alias("late"))
    out = materialize(first.where("not short").select(*columns, F.lit(0).alias("late")).unionByName(second), "runs")
    release(first, needed)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: (id_col, n_shingles, component_id), components of the links 100 |A & B| >= percent |A | B|.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer than ``size`` words is one shingle; a null text or one
    without words has none, is linked with nothing and is its own component. Equal sets are one node, so copies cost one row each.
    Rows with the same id are all returned; a null id takes no part in naming a component (its component_id is the smallest other
    id, or null). An empty table gives an empty result; further columns of docs play no part.
    """
    bound = min(1 << 48, int(AHEAD * (100 - percent) / 100 * (1 << 48)) + 1)
    all_sets = materialize(shingle_sets(docs, id_col, text_col, size, bound), "sets", "none")
    numbers = ["n", "low"]
    nodes = materialize(all_sets.where("n > 0").groupBy("sig").agg(F.min("id").alias("first_id"), *(F.min(c).alias(c) for c in numbers)), "nodes")
    runs = _prefixes(all_sets.where("n > 0"), nodes, bound, percent)

    alike_size = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    need = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})"
    # What both prefixes hold is counted; of the set whose prefix ends first in the order, only what lies beyond it can be common besides.
    beyond = "greatest(na - pa, nb - pb)"
    bounds = {"least_common": f"{need} - {beyond} - least(latea, lateb)", "first_fits": f"least(na - ata, nb - atb) >= {need}"}  # from the first one in common on, no more than the rest of either
    side = lambda df, s, *more: df.select("tok", F.col("sig").alias(s), *(F.col(c).alias(f"{c}{s}") for c in ("n", "p", "at", "late", "held", "most", *more)))

    rare = runs.where("not frequent")
    both = side(rare, "a").join(side(rare, "b"), "tok").where(f"a < b and {alike_size} and least(mosta, mostb) >= {need}").select("a", "b", *(F.expr(x).alias(c) for c, x in bounds.items()))
    found = both.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("least_common").alias("least_common"), F.max("first_fits").alias("first_fits"))
    pairs = found.where("first_fits and common >= least_common").select("a", "b")

    late = runs.where("frequent").withColumn("place", F.expr("((p - late) * 4095L div n << 50) | (shiftright(sig, 14) & ((1L << 50) - 1))"))
    least = late.groupBy("tok").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.min_by("sig", "place").alias("a"), F.min_by("n", "place").alias("na"), F.min_by("held", "place").alias("helda")).where("lo <> hi")
    sized = late.select("tok", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("held").alias("heldb")).join(least.select("tok", "a", "na", "helda"), "tok")
    pairs = materialize(pairs.unionByName(sized.where(f"a <> b and {alike_size} and least(helda, heldb) >= {need}").select("a", "b").distinct()), "pairs")
    links = _linked(all_sets, nodes, pairs, percent)

    labels = connected_components(links)
    labelled = runs.where("frequent").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = labelled.groupBy("tok").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("tok")
    open_runs = materialize(labelled.join(mixed, "tok"), "open")
    # A pair is compared once, at the first frequent shingle of its open lists, and only if these and its rare ones may suffice.
    per_set = ["sig", "n", "p", "late", "held", "most", "component"]
    whole = open_runs.groupBy(*per_set).agg(F.expr("transform(sort_array(collect_list(struct(at, tok))), x -> x.tok) AS own"))
    placed = whole.select(*per_set, "own", F.posexplode("own").alias("at", "tok"))
    first_here = "not arrays_overlap(slice(owna, 1, ata), slice(ownb, 1, atb))"
    enough = f"size(array_intersect(owna, ownb)) + least(pa - latea, pb - lateb) + {beyond} >= {need}"
    # Of all frequent shingles of a set (their number follows from late) and of its shared rare ones no more can be common than either side has.
    kinds = " + ".join(f"least({a('a')}, {a('b')})" for a in (lambda s: f"late{s} + n{s} - p{s}", lambda s: f"held{s} - late{s} - n{s} + p{s}"))
    cross = side(placed, "a", "component", "own").join(side(placed, "b", "component", "own"), "tok").where(f"componenta <> componentb and a < b and {alike_size} and {kinds} >= {need} and {first_here} and {enough}")
    more_pairs = materialize(cross.select("a", "b"), "pairs")
    more = _linked(all_sets, nodes, more_pairs, percent)
    final = connected_components(links.unionByName(more))

    by_sig = nodes.join(final.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first_id", F.coalesce("component", "sig").alias("component"))
    least_id = by_sig.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = by_sig.join(least_id, "component").select("sig", "component_id")
    out = all_sets.select("id", "sig", "n").join(names, "sig", "left")
    out = materialize(out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")), "components")
    release(all_sets, nodes, runs, pairs, links, labels, open_runs, more_pairs, more, final)
    return out


def _linked(all_sets: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that hold, each compared over its whole sets."""
    needed = _only(all_sets, nodes, pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))))
    links = materialize(_verified(pairs, needed, percent), "links")
    release(needed)
    return links


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id names its own component in groups, which is jaccard_components(docs); all rows of such an id, and those without an id.

    Ids that stay and ids that go set bits of two bitmaps of fixed size, 8 MB each at most. A row whose cell only one kind holds is decided where it
    lies; only the texts of the others are shuffled, to be joined by id. Ids far beyond 2 ** BITS fill both bitmaps; then all rows are joined.
    """
    own = free_prefix(docs, groups)
    cell = lambda c: f"((cast({c} as long) ^ shiftright(cast({c} as long), {BITS})) & {(1 << BITS) - 1})"
    stays = f"{id_col} = component_id"
    bits = [F.expr(f"bitmap_construct_agg({cell(id_col)} % 32768) FILTER (WHERE {which})").alias(f"{own}{c}") for c, which in (("stay", stays), ("go", f"not {stays}"))]
    cells = groups.where(f"{id_col} is not null").groupBy(F.expr(f"{cell(id_col)} div 32768").alias(f"{own}part")).agg(*bits)
    placed = docs.withColumn(f"{own}part", F.expr(f"{cell(id_col)} div 32768")).join(F.broadcast(cells), f"{own}part", "left")
    held = lambda c: f"getbit(cast(conv(hex(substring({own}{c}, cast({cell(id_col)} % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast({cell(id_col)} % 8 as int)) = 1"
    sure = placed.where(f"not coalesce({held('go')}, false)").select(*docs.columns)
    unsure = placed.where(f"{held('go')} and {held('stay')}").select(*docs.columns)
    # The ids that stay grow with the documents: no broadcast. A semi-join would be moved below the bitmaps, and all texts shuffled.
    return sure.unionByName(unsure.join(groups.where(stays).select(id_col).distinct().hint("merge"), id_col).select(*docs.columns))
