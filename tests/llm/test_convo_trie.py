"""The conversation trie against nested lists: plain rebuilding, every prefix by itself; small blocks and limits force each way through."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidewatch.llm.convo_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, group=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows, **k):
    convs = rebuilt(rows, **k)
    members, last = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        last[tuple(turns)].append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(last[node]))) if node in last else ""
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), sum((len(members[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema=SCHEMA, **k):
    return sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema), **k).collect()), key=str)


def made(seed, n_convs, longest, texts):
    dice = random.Random(seed)
    rows = []
    for c in dice.sample(range(0, n_convs * 2), n_convs):
        rows += [(c, t, dice.choice(["user", "assistant", None]), dice.choice(texts)) for t in range(dice.randint(1, longest))]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block", "limit"), [(1024, 100_000), (3, 100_000), (1024, 8), (2, 5)])
def test_random_conversations(spark, block, limit):
    rows = made(block * 100 + limit, 70 if limit > 5 else 30, 7, ["a b", "a b c", "", None, "x\ty\x0bz", "word"])
    assert got(spark, rows, block=block, limit=limit) == brute(rows)


def test_a_third_of_all_share_a_beginning_and_some_are_copies(spark):
    long = [(c, t, "user", f"the same turn {t}") for c in range(100, 140) for t in range(9)]
    fork = [(c, 9, "user", f"own {c % 5}") for c in range(100, 130)]
    rows = long + fork + made(3, 40, 4, ["p q", "r"])
    rows = [r for r in rows if r[0] is not None]
    assert got(spark, rows, limit=12) == brute(rows)
    assert got(spark, rows, block=4, limit=12) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "null turn first"), (0, 5, None, None), (0, 5, "user", "tie"), (0, 5, "user", "tie"), (0, -4, "", ""), (1, 1, "user", "short"), (2, 1, "user", "short"), (41, 1, "user", "no base"), (42, 2, "user", "no base"),
        (-7, 1, "user", "minus"), (-7, 2, "user", "minus two"), (-20, 1, "s", "base of minus"), (None, 1, "user", "of no conversation"), (1 << 40, 1, "user", "é 😀 x"), (60, 1, "user", "word " * 20_000), (60, 10**12, "user", "far"),
    ]
    assert got(spark, rows) == brute(rows)
    more = [(*r, "x", 1) for r in rows]
    assert got(spark, more, SCHEMA + ", digest string, k int") == brute(rows)
    assert got(spark, rows, group=7, heads=2, block=2) == brute(rows, group=7, heads=2)


def test_turnless_only_and_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    alone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 1, "user", "dropped")]
    assert got(spark, rows) == brute(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
