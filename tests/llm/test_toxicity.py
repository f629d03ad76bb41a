"""The factorization machine against plain loops, a planted interaction, held-out labels and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm.common import WordHasher, text_slices
from tidewatch.llm.toxicity import BITS, BLOCK, Machine, block_terms, fit, score_texts, score_toxicity, train, word_spans


def terms_of(text):
    """(block, term) pairs of one text, lower-cased as the operator does."""
    ((_, raw, offsets),) = text_slices(pa.array([text.lower()]), 1 << 26)
    block, term, _ = block_terms(WordHasher(), raw, offsets)
    return block, term


def a_machine(seed=3):
    dice = np.random.default_rng(seed)
    return Machine(-0.5, dice.normal(0, 0.3, 1 << BITS), dice.normal(0, 0.3, (1 << BITS, 4)), dice.random(1 << BITS) < 0.7, 1.3, 0.2)


def plain_score(machine, text):
    """The worst passage by loops over pairs of terms."""
    block, term = terms_of(text or "")
    own = {}
    for b, t in zip(block.tolist(), term.tolist(), strict=True):
        if machine.known[t]:
            own.setdefault(b, []).append(t)
    n = math.ceil(len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")) / BLOCK)
    best = None
    for b in range(max(1, n - 1)) if n else []:
        terms = own.get(b, []) + (own.get(b + 1, []) if b + 1 < n else [])
        s = machine.bias + sum(machine.weights[t] for t in terms)
        pairs = sum(float(machine.vectors[t] @ machine.vectors[u]) for i, t in enumerate(terms) for u in terms[:i])
        s += pairs / max(1, len(terms))
        best = s if best is None else max(best, s)
    best = machine.bias if best is None else best
    return 1 / (1 + math.exp(-(machine.slope * best + machine.shift)))


def test_scores_match_plain_loops(spark):
    dice = random.Random(4)
    words = ["alpha", "alphabet", "beta", "GAMMA", "idiot!", "é-é", "x", "ünder|way", "alphas"]
    texts = [" ".join(dice.choice(words) + str(dice.randint(0, 60)) * dice.randint(0, 1) for _ in range(n)) for n in (1, 5, 127, 128, 129, 256, 257, 300, 700)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n.,;", *texts, texts[0], "same", "same", "SAME"])]
    machine = a_machine()
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id long, text string, score double, id string")
    got = {r["doc_id"]: r for r in score_texts(docs, machine).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(plain_score(machine, t), abs=1e-9), (i, t)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert got[len(rows) - 1]["score"] == got[len(rows) - 2]["score"]


def test_word_spans_do_not_cross_texts():
    raw, offsets = np.frombuffer(b"ab cdef  g", np.uint8), np.array([0, 4, 4, 10])
    rows, start, end = word_spans(raw, offsets)
    assert list(zip(rows.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 0, 2), (0, 3, 4), (2, 4, 7), (2, 9, 10)]


def planted(n, seed):
    """Toxic if an insult stands beside a group; each alone is common in clean texts too."""
    dice = random.Random(seed)
    plain = [f"word{i}" for i in range(120)]
    out = []
    for _ in range(n):
        insult, group = dice.random() < 0.5, dice.random() < 0.5
        words = [dice.choice(plain) for _ in range(dice.randint(6, 14))] + ["vermin"] * insult + ["martians"] * group
        dice.shuffle(words)
        out.append((int(insult and group), " ".join(words)))
    return out


def test_learns_an_interaction_that_weights_alone_miss():
    def learned(rows, **k):
        return train([(y, *terms_of(t)) for y, t in rows], **k)

    machine = learned(planted(1500, 1), epochs=40)
    own = [(y, plain_score(machine, t)) for y, t in planted(400, 2)]
    assert np.mean([(s >= 0.5) == y for y, s in own]) > 0.97
    pair = plain_score(machine, "vermin martians word1 word2 word3 word4 word5")
    assert pair > 0.7 > 0.5 > max(plain_score(machine, f"{w} word1 word2 word3 word4 word5 word6") for w in ("vermin", "martians", "word7"))


def test_held_out_labels_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    wrong = [r["predicted"] for r in rows if not r["toxic"]]
    assert right > 0.97 and np.mean(caught) > 0.8 and np.mean(wrong) < 0.005
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_sample_is_bounded_and_held_out_rows_teach_nothing(spark):
    rows = [(i, t, y) for i, (y, t) in enumerate(planted(900, 5))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "repeated id"), (None, "no id"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(7, 0, 0), (5000, 0, 0), (9999, 0, 1), (8, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    machine = fit(docs, labels)
    lied = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = fit(docs, lied)
    assert np.array_equal(machine.weights, again.weights) and np.array_equal(machine.vectors, again.vectors)
    from tidewatch.llm.toxicity import training_sample

    few = training_sample(docs, labels, "doc_id", "text", (100, 50), 10_000_000, 1_000_000).groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in few}[0] < 160 and {r["toxic"]: r["count"] for r in few}[1] < 90
    tiny = training_sample(docs, labels, "doc_id", "text", (4000, 2000), 3000, 1_000_000).collect()
    assert sum(len(r["text"]) for r in tiny) < 12_000


def test_no_labels_one_label_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r["score"] < 1e-9 for r in score_toxicity(docs, none).collect())
    all_toxic = spark.createDataFrame([(i, 1) for i in range(1, 3)], "doc_id long, toxic int")
    assert {r["predicted"] for r in score_toxicity(docs, all_toxic).collect()} in ({1}, {0})
    assert score_toxicity(docs.limit(0), none).collect() == []
