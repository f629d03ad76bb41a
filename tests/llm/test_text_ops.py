import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import queries as Q
from tidewatch.llm.line_dedup import dedup_lines
from tidewatch.llm.ngram_join import jaccard_components, walk_tree
from tidewatch.llm.packing import pack_by_curve
from tidewatch.llm.quality import fertility_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, n long, sig long, line string"


def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE  two"), (5, "one two three four five"), (6, "<|endoftext|> and " * 40)]
    for i in range(7, 40):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    for i in range(40, 80):
        rows.append((i, shared + "\n" + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))))
    rows.append((80, " ".join(rng.choice(words) for _ in range(30000)) + "\n" + "x" * 50000))
    rows.append((81, "The Same Line of some length\n  the same line of SOME length \nthe same line"))
    rows += [(i, "the same line of some length\nçé " + str(i)) for i in range(82, 86)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, "l") for i, t in rows], SCHEMA).repartition(3)


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_components_equal_brute_force(spark):
    assert got(Q.op1_ngram_jaccard_join(spark, SF)) == brute.components(corpus(spark))
    rows = odd_rows()
    assert got(jaccard_components(frame(spark, rows))) == brute.components(rows)
    assert jaccard_components(frame(spark, rows).where("false")).count() == 0


def test_components_of_repeated_and_null_ids(spark):
    text = "a b c d e f g h"
    out = jaccard_components(spark.createDataFrame([(3, text), (3, text), (None, text), (9, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in out) == [(-1, 4, 3), (3, 4, 3), (3, 4, 3), (9, 0, 9)]


def test_walk_tree_equals_plain_sets():
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        hub = sorted(rng.sample(range(1000), rng.randrange(1, 300)))
        sets = []
        for _ in range(10):
            own = set(hub)
            for _ in range(rng.randrange(0, len(hub) // 3 + 2)):
                own.discard(rng.choice(hub))
                own.add(rng.randrange(1000))
            sets.append(sorted(own))
        want = [100 * len(set(hub) & set(s)) >= 80 * len(set(hub) | set(s)) for s in sets]
        assert list(walk_tree(np.array(hub, np.uint64), [np.array(s, np.uint64) for s in sets], 80)) == want


def test_quality_counts_equal_brute_force(spark):
    rows = corpus(spark) + [(1000 + i, t) for i, t in odd_rows()] + [(2000, "a b\na b\n\n \n \na b"), (2001, "x#*$%&|<> []")]
    out = got(fertility_rules(frame(spark, rows), Q.rule_vocabularies(spark), Q.rule_pieces(spark)))
    assert len(out) == len(rows)
    for i, text in rows:
        assert out[i][:6] == brute.quality(text), i
        assert not (out[i][5] and out[i][6])
    assert fertility_rules(frame(spark, rows).where("false"), Q.rule_vocabularies(spark), Q.rule_pieces(spark)).count() == 0


#: The first articles of the Universal Declaration of Human Rights.
CLEAN = {
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες που προκηρύσσει η παρούσα διακήρυξη, χωρίς καμία απολύτως διάκριση.",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחירויות שנקבעו בהכרזה זו ללא הפליה כלשהי מטעמי גזע, צבע, מין, לשון, דת.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق، وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। सभी को इस घोषणा में सन्निहित सभी अधिकारों और आजादियों को प्राप्त करने का हक़ है।",
    "kana": "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、この宣言に掲げるすべての権利と自由とを享有することができる。",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解、国籍或社会出身、财产、出生或其他身分等任何区别。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해와 같은 어떠한 종류의 차별이 없이 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다.",
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind.",
}


def test_quality_bands_tell_clean_text_from_junk(spark):
    from tidewatch.llm import quality

    models, covered, rng = quality._models(Q.rule_vocabularies(spark)), quality.covered_points(Q.rule_pieces(spark).value), random.Random(3)
    for script, text in CLEAN.items():
        kept, found, measures = quality.judged(text, models, covered)
        assert (kept, found) == (True, script), (script, measures)
        junk = [(text[:6] + " ") * 60, "".join(chr(0x1F600 + rng.randrange(80)) if i % 2 else c for i, c in enumerate(text))]
        if script in ("greek", "cyrillic", "hebrew", "arabic", "hangul"):  # scripts with spaces: shuffled letters
            letters = list(text.replace(" ", "") * 4)
            rng.shuffle(letters)
            junk.append("".join(c + (" " if i % 6 == 5 else "") for i, c in enumerate(letters)))
        if script not in ("latin", "kana", "han"):
            junk.append(text.encode().decode("latin-1"))
        for bad in junk:
            kept, found, measures = quality.judged(bad, models, covered)
            assert not kept, (script, found, measures, bad[:40])


def test_quality_of_repeated_and_null_ids(spark):
    rows = [(None, CLEAN["latin"]), (4, CLEAN["latin"]), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, kept string")
    out = fertility_rules(docs, Q.rule_vocabularies(spark), Q.rule_pieces(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in out) == sorted((i or -1, len((t or "").split())) for i, t in rows)


def test_packing_is_a_partition_of_all_ids(spark):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus(spark)[:60] + [(1000 + i, t) for i, t in odd_rows()]
    out = pack_by_curve(frame(spark, rows), Q.bpe_vocabulary(spark)).collect()
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), brute.crc(ids[i][at : at + r.length]))
            at += r.length
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) == -(-sum(map(len, ids.values())) // 2048)
    assert pack_by_curve(frame(spark, rows).where("false"), Q.bpe_vocabulary(spark)).count() == 0


def test_hilbert_neighbours():
    import numpy as np

    from tidewatch.llm.packing import hilbert_keys

    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(grid, 3)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("batch_lines,fanout", [(10**9, 2), (400, 2)])
def test_line_dedup_equals_brute_force(spark, batch_lines, fanout):
    rows = corpus(spark) + [(1000 + i, t) for i, t in odd_rows()] + [(None, "the same line of some length")]
    out = dedup_lines(frame(spark, rows), batch_lines=batch_lines, fanout=fanout).collect()
    want = brute.line_dedup(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out], key=key) == sorted(want, key=key)
    assert dedup_lines(frame(spark, rows).where(F.lit(False))).count() == 0


def test_line_dedup_of_repeated_ids_and_own_columns(spark):
    line = "a line that many of the documents hold"
    rows = [(5, line + "\nx", 1), (5, line + "\ny", 2), (4, line, 3), (3, line, 4), (None, line, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_gone long").withColumn("__key", F.lit("k"))
    out = sorted((r.own_gone, r["__key"], r.kept_text, r.n_dropped) for r in dedup_lines(docs).collect())
    assert out == [(1, "k", line + "\nx", 0), (2, "k", line + "\ny", 0), (3, "k", "", 1), (4, "k", "", 1), (5, "k", line, 0)]


def test_kept_lines_of_one_long_text(spark):
    lines = [f"line number {i} of the text" for i in range(40000)]
    rows = [(i, "\n".join(lines[i * 7 :: 3])) for i in range(5)]
    out = sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted(brute.line_dedup(rows))
