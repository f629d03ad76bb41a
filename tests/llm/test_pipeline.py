"""The pipeline against a plain version of its stages."""

import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import pii
from tidewatch.llm.ngram_join import first_of_each
from tidewatch.llm.queries import rule_pieces, rule_vocabularies
from tidewatch.llm.quality import fertility_rules

SF = "/root/testdata/sf0.001"


def without_common_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.ASCII_LOW)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    common = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    return [(i, "\n".join(line for line in text.split("\n") if common.get(key(line), i) == i)) for i, text in docs]


def test_run_equals_the_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in fertility_rules(docs, rule_vocabularies(spark), rule_pieces(spark)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not any(verdicts[i] and brute.quality(text)[-1] for i, text in rows)
    kept = without_common_lines([(i, text) for i, text in rows if verdicts[i]])
    groups = brute.components(kept)
    first = [(i, text) for i, text in kept if groups[i][1] == i]
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(first, "doc_id long, text string")).collect()}
    for i, text in first:
        for span in brute.pii_base(text):
            _, start, end = span.split(":")
            assert text[int(start) : int(end)] not in redacted[i]
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(bpe.encode(text, add_special_tokens=False).ids) + 1 for i, text in redacted.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    got, filled = defaultdict(int), defaultdict(int)
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        filled[p["sequence_id"]] += p["length"]
    assert dict(got) == want
    assert sorted(filled) == list(range(len(filled))) and all(filled[s] == 2048 for s in sorted(filled)[:-1])


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, ties, an empty table and further columns."""
    words = " ".join(f"word{i * 7919 % 1009}" for i in range(120))
    rows = [(None, words, "en"), (None, None, None), (1, words, "en"), (1, words, "en"), (2, words, None), (3, "", "en"), (4, None, "en"), (5, "x " * 50000, "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string")
    ids = lambda df: sorted((r.doc_id or -1) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "quality_rules":
            assert set(ids(out)) <= {-1, 1, 2}
        elif name == "near_duplicates":
            assert ids(out) == [-1, -1, 1, 1, 3, 4, 5]
        elif name == "pack":
            assert set(ids(out)) == {-1, 1, 2, 3, 4, 5}
        else:
            assert ids(out) == sorted((r[0] or -1) for r in rows)
        if name != "pack":
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), SF).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for a shuffle."""
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicates_do_not_shuffle_the_texts(spark):
    """Only rows that the bitmaps leave open are joined, so what the join writes does not grow with the texts."""
    dice = random.Random(3)
    texts = [" ".join(f"{dice.getrandbits(40):x}" for _ in range(200)) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 300], "en", "s", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more ids than may be broadcast
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, SF)
        before = shuffled(spark)
        rows = out.collect()
        assert shuffled(spark) - before < 100_000 < sum(map(len, texts)) // 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.doc_id, r.text) for r in rows) == list(enumerate(texts))


def test_first_of_each_where_ids_share_a_cell(spark):
    """Ids that stay and ids that go in one cell, an id whose rows do both, ids below zero and none: as the plain join."""
    far = lambda i: (1 << 26) + (i ^ 1)  # noqa: E731, the cell of i
    groups = [(5, 5), (far(5), 5), (far(7), 7), (7, 7), (8, 8), (far(8), far(8)), (9, 5), (11, 11), (11, 5), (-3, -3), (-4, -3), (1 << 62, 5), ((1 << 62) + 1, (1 << 62) + 1), (None, 5), (None, None)]
    docs = spark.createDataFrame([(i, str(n)) for n, (i, _) in enumerate(groups)], "doc_id long, text string")
    stay = {i for i, c in groups if i is not None and i == c}
    got = first_of_each(docs, spark.createDataFrame(groups, "doc_id long, component_id long")).collect()
    assert sorted(r.text for r in got) == sorted(str(n) for n, (i, _) in enumerate(groups) if i is None or i in stay)
