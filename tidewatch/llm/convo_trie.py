"""Prefix tries of conversations: what many conversations begin with, and how many tokens a shared prefix saves.

Conversations are rows of turn digests. Copies become one path with a count. Paths are dealt by a digest of their first turn, a trie of pointer
dictionaries is built for each such group inside applyInPandas, and sums over subtrees come from an iterative postorder. A group of more than
``limit`` turns is dealt again by its next turn, as often as needed; the turns that all paths of such a group have in common become nodes at once, so
the number of rounds follows the branchings, not the turns. Conversations of more than ``block`` turns are cut into blocks, each a path of its own
trie under the digest of what goes before it, and sums are handed upwards block by block: no row, group or task holds an unbounded conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, release

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a path, and turns of the paths that one trie is built from.
BLOCK, LIMIT = 1024, 100_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _short(digest: Column) -> Column:
    """The first 16 bytes of a hex digest."""
    return F.unhex(F.substring(digest, 1, 32))


def _joined(digests: Column) -> Column:
    return _short(F.sha2(F.array_join(F.transform(digests, F.hex), ""), 256))


def numbered_turns(conversations: DataFrame, block: int) -> DataFrame:
    """(conv_id, cell, place, digest, words): turns dealt by conversation and range of turn numbers, with their place there.

    Null role and text are empty. Turns of one number go by their digest, so that any order of equal rows gives the same; rows without an id are of no
    conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = _short(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    own = own.withColumn("cell", F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))))
    window = Window.partitionBy("conv_id", "cell").orderBy(F.asc_nulls_first("turn"), "digest")
    return own.withColumn("place", F.row_number().over(window).cast("long")).select("conv_id", "cell", "place", "digest", "words")


def rebuilt_turns(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, total, digest, words) of the rebuilt conversations, and (conv_id, total) of all of them.

    Conversation c takes the first h turns of conversation c - c % group (fewer if that has fewer), h = crc32 of the decimal id modulo heads, then its own
    turns after its first h.
    """
    in_order = Window.partitionBy("conv_id").orderBy("cell")
    cells = turns.groupBy("conv_id", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("conv_id", "cell", before.alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("own"))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).join(cells, ["conv_id", "cell"]).where(F.col("place") + F.col("before") < heads)
    head = F.array_sort(F.collect_list(F.struct((F.col("place") + F.col("before")).alias("pos"), "digest", "words")))
    bases = first.groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    placed = cells.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group}).join(bases, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(dict(bases.dtypes)["head"])), F.lit(1), F.col("h"))
    placed = placed.withColumn("taken", taken).withColumn("total", F.size("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    borrowed = placed.where("before = 0").select("conv_id", "total", F.explode("taken").alias("t")).select("conv_id", "t.pos", "total", "t.digest", "t.words")
    kept = turns.join(placed.select("conv_id", "cell", "before", "h", "total", F.size("taken").alias("shift")), ["conv_id", "cell"]).where("place + before > h")
    kept = kept.select("conv_id", (F.col("place") + F.col("before") - F.col("h") + F.col("shift")).alias("pos"), "total", "digest", "words")
    return borrowed.unionByName(kept), placed.where("before = 0").select("conv_id", "total")


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, total, digests, words, path): the k-th block of turns of each conversation, and its digest."""
    row = F.array_sort(F.collect_list(F.struct("pos", "digest", "words")))
    own = turns.groupBy("conv_id", "total", F.floor((F.col("pos") - 1) / block).cast("long").alias("k")).agg(row.alias("rows"))
    return own.select("conv_id", "k", "total", F.col("rows.digest").alias("digests"), F.col("rows.words").alias("words"), _joined(F.col("rows.digest")).alias("path"))


def chained(blocks: DataFrame, block: int) -> DataFrame:
    """blocks (with path, the digest of each) with prefix (of all blocks before it) and next (of these and itself; null without a later block)."""
    none = F.lit(b"")
    short = blocks.where(F.col("total") <= block).withColumns({"prefix": none, "next": F.lit(None).cast("binary")})
    order = Window.partitionBy("conv_id").orderBy("k")
    so_far = lambda end: F.collect_list("path").over(order.rowsBetween(Window.unboundedPreceding, end))
    long = blocks.where(F.col("total") > block).withColumns({"b": so_far(-1), "e": so_far(0)})
    more = F.col("total") > (F.col("k") + 1) * block
    long = long.withColumns({"prefix": F.when(F.size("b") > 0, _joined(F.col("b"))).otherwise(none), "next": F.when(more, _joined(F.col("e")))}).drop("b", "e")
    return short.unionByName(long)


def end_digests(ends: DataFrame) -> DataFrame:
    """(prefix, path, ends_sha256): SHA-256 of the ascending, comma-joined ids of the rows (prefix, path, conv_id), read as one sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for rows in batches:
            done = []
            for prefix, path, conv in zip(rows["prefix"], rows["path"], rows["conv_id"], strict=True):
                if (prefix, path) != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (prefix, path), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pd.DataFrame(done, columns=["prefix", "path", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=["prefix", "path", "ends_sha256"])

    own = ends.select("prefix", "path", "conv_id").repartition("prefix", "path").sortWithinPartitions("prefix", "path", "conv_id")
    return own.mapInPandas(run, "prefix binary, path binary, ends_sha256 string")


_READY = ["key", "up", "at", "parent_low", "digests", "words", "n", "low", "ends", "below_children", "below_leaves", "below_saved"]


def build_tries(paths: DataFrame, base_depth: int, limit: int) -> DataFrame:
    """The nodes of the tries of paths, with ``up`` (the group above) for the top node of each trie and null for the others.

    A group holds whole tries of some ``limit`` turns; its dictionaries point from (node, digest of the next turn) to the next node.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        pointers: dict = {}
        above, depth, n, low, words, up, parent, ends, kids, leaves, saved = ([] for _ in range(11))

        def child(node: int, digest: bytes, its_depth: int, its_words: int) -> int:
            found = pointers.get((node, digest))
            if found is None:
                found = pointers[node, digest] = len(above)
                for column, value in ((above, node), (depth, its_depth), (n, 0), (low, None), (words, its_words), (up, None), (parent, None), (ends, None), (kids, 0), (leaves, 0), (saved, 0)):
                    column.append(value)
            return found

        for key, its_up, at, parent_low, digests, its_words, count, smallest, end, more, more_leaves, more_saved in rows[_READY].itertuples(index=False, name=None):
            node = -1
            for i in range(at - 1, len(digests)):
                node = child(node, key if node < 0 else digests[i], i + 1, its_words[i])
                if i == at - 1:
                    up[node], parent[node] = its_up, parent_low
                n[node] += count
                low[node] = smallest if low[node] is None else min(low[node], smallest)
            if end is not None:
                ends[node] = end
            kids[node], leaves[node], saved[node] = kids[node] + more, leaves[node] + more_leaves, saved[node] + more_saved
        for node in range(len(above) - 1, -1, -1):  # nodes are numbered after the one above them: backwards is a postorder
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * int(words[node])
            if above[node] >= 0:
                to = above[node]
                kids[to], leaves[to], saved[to] = kids[to] + 1, leaves[to] + leaves[node], saved[to] + saved[node]
                parent[node] = low[to]
        return pd.DataFrame({
            "up": up, "conv_id": low, "depth": [base_depth + d for d in depth], "parent_conv_id": parent, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or _NO_ENDS for e in ends],
        })

    size = paths.agg(F.coalesce(F.sum(F.size("digests") - F.col("at") + 1), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-size // limit), min(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 1000))
    return paths.select(*_READY, F.pmod(F.xxhash64("key"), F.lit(groups)).alias("bucket")).groupBy("bucket").applyInPandas(build, f"up binary, {NODE}")


def _tops(nodes: DataFrame) -> DataFrame:
    """(above, children, leaves, saved): the sums of what hangs below each group."""
    own = nodes.where("up is not null").groupBy(F.col("up").alias("above"))
    return own.agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    first_other = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"])), F.lit(True))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(a)).cast("int")


def split_groups(state: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of at most ``limit`` turns, and for each round the groups that were dealt again (largest first), their common turns with them."""
    ready, spines = [], []
    while True:
        sizes = state.groupBy("key", "up", "at", "parent_low").agg(
            F.sum(F.size("digests") - F.col("at") + 1).alias("turns"), F.count("*").alias("paths"), F.sum("n").alias("n"), F.min("low").alias("low"), F.min("digests").alias("least"), F.max(F.struct("digests", "words")).alias("most")
        )
        big = materialize(sizes.where((F.col("turns") > limit) & (F.col("paths") > 1)).withColumn("to", _common(F.col("least"), F.col("most.digests"))).drop("least", "turns", "paths"), "spine")
        if big.isEmpty():
            release(big)
            return [*ready, state], spines
        ready.append(materialize(state.join(big.select("key"), "key", "left_anti"), "ready"))
        cut = state.join(big.select("key", "to", F.col("low").alias("top_low")), "key")
        ended = cut.where(F.size("digests") == F.col("to")).select("key", "ends", "below_children", "below_leaves", "below_saved")
        spines.append(materialize(big.join(ended, "key", "left"), "spine"))
        on = cut.where(F.size("digests") > F.col("to"))
        following = F.get("digests", F.col("to"))
        state = on.select(
            _short(F.sha2(F.concat("key", following), 256)).alias("key"), F.col("key").alias("up"), (F.col("to") + 1).alias("at"), F.col("top_low").alias("parent_low"), *[c for c in _READY if c not in ("key", "up", "at", "parent_low")]
        )
        state = materialize(state, "split")
        release(big)


def spine_nodes(spine: DataFrame, tops: DataFrame, base_depth: int) -> DataFrame:
    """The nodes of the common turns of groups that were dealt again, from the sums of what they were dealt into."""
    own = spine.join(tops.select(F.col("above").alias("key"), "children", "leaves", "saved"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    words = F.slice(F.col("most.words"), F.col("at"), F.col("to") - F.col("at") + 1)
    own = own.withColumns({"children": zero("children") + zero("below_children"), "leaves": zero("leaves") + zero("below_leaves"), "saved": zero("saved") + zero("below_saved"), "w": words})
    own = own.withColumn("i", F.explode(F.sequence("at", "to")))
    rest = F.aggregate(F.slice("w", F.col("i") - F.col("at") + 1, F.col("to")), F.lit(0).cast("long"), lambda s, x: s + x)
    last, top = F.col("i") == F.col("to"), F.col("i") == F.col("at")
    return own.select(
        F.when(top, F.col("up")).alias("up"), F.col("low").alias("conv_id"), (F.lit(base_depth) + F.col("i")).cast("long").alias("depth"), F.when(top, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(_NO_ENDS).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations, with the columns of NODE.

    conversations has conv_id, turn, role and text; further columns play no part. A node is a distinct sequence of first turns (role, text), the root the
    empty one (null parent); conv_id is the smallest conversation that begins with it, and no two nodes share conv_id and depth. n_convs counts the
    conversations that begin with it, n_children the nodes one turn longer, n_leaves the childless nodes of its subtree (itself included), saved_tokens
    sums (n_convs - 1) times the words of the last turn over its subtree, ends_sha256 digests the ids of the conversations that are this sequence.

    Null role and text are empty; a null turn comes first; turns of one number go by a digest of role and text, repeated rows each count; rows without
    a conv_id are of no conversation. An empty table has no conversation and gives no row.
    """
    turns = materialize(numbered_turns(conversations, block), "turns")
    rows, convs = rebuilt_turns(turns, group, heads)
    convs = materialize(convs, "convs")
    whole = materialize(blocks_of(rows, block), "blocks")
    blocks = chained(whole, block)
    ends = materialize(end_digests(blocks.where("next is null").unionByName(convs.where("total = 0").select("conv_id", F.lit(b"").alias("prefix"), F.lit(b"").alias("path")), allowMissingColumns=True)), "ends")
    paths = blocks.groupBy("k", "prefix", "path").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.max(F.struct("digests", "words")).alias("row"), F.max("next").alias("next"))
    paths = materialize(paths.join(ends.withColumnRenamed("ends_sha256", "ends"), ["prefix", "path"], "left"), "paths")

    all_convs = convs.agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).first()
    nodes, below = None, None
    for k in range(paths.agg(F.max("k")).first()[0] or 0, -1, -1):  # later blocks first: their sums go to the block above
        own = paths.where(F.col("k") == k)
        sums = ["below_children", "below_leaves", "below_saved"]
        if below is None:
            own = own.withColumns({c: F.lit(0).cast("long") for c in sums})
        else:
            own = own.join(below.select(F.col("above").alias("next"), *[F.col(c).alias(f"below_{c}") for c in ("children", "leaves", "saved")]), "next", "left").fillna(0, sums)
        if k:
            own = own.join(paths.where(F.col("k") == k - 1).select(F.col("next").alias("prefix"), F.col("low").alias("parent_low")).where("prefix is not null"), "prefix")
        else:
            own = own.withColumn("parent_low", F.lit(all_convs["low"]).cast("long"))
        key = _short(F.sha2(F.concat("prefix", F.get("row.digests", F.lit(0))), 256))
        state = own.select(key.alias("key"), F.col("prefix").alias("up"), F.lit(1).alias("at"), "parent_low", F.col("row.digests").alias("digests"), F.col("row.words").alias("words"), "n", "low", "ends", *sums)
        ready, spines = split_groups(state, limit)
        built = ready[0]
        for more in ready[1:]:
            built = built.unionByName(more)
        found = materialize(build_tries(built, k * block, limit), "tries")
        for spine in reversed(spines):
            found = found.unionByName(materialize(spine_nodes(spine, _tops(found), k * block), "spines"))
        below = materialize(_tops(found), "tops")
        nodes = found if nodes is None else nodes.unionByName(found)

    hung = below.where(F.col("above") == F.lit(b"")).first()
    empty = ends.where((F.col("prefix") == F.lit(b"")) & (F.col("path") == F.lit(b""))).first()
    release(turns, convs, whole, ends, paths, below)
    if not all_convs["n"]:
        return nodes.drop("up")
    root = (all_convs["low"], 0, None, all_convs["n"], hung["children"] if hung else 0, hung["leaves"] if hung else 1, hung["saved"] if hung else 0, empty["ends_sha256"] if empty else _NO_ENDS)
    return nodes.drop("up").unionByName(turns.sparkSession.createDataFrame([root], NODE))
