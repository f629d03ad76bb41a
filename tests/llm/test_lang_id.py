import zlib

import numpy as np

from tidewatch.llm import queries as Q
from tidewatch.llm.lang_id import BiGru, identify


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = BiGru(["a", "b", "c"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    codes = rng.integers(97, 105, (5, 6))
    codes[1, 3:] = 256
    labels = np.array([0, 1, 2, 1, 0])
    _, grad = model.gradients(codes, labels)
    for name in ("uf", "ub", "cf", "o", "ob", "xb"):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in model.p[name].shape)
            if name == "xb":
                at = (int(codes[0, 0]), at[1])
            old, step = model.p[name][at], 1e-3
            model.p[name][at] = old + step
            up = model.gradients(codes, labels)[0]
            model.p[name][at] = old - step
            down = model.gradients(codes, labels)[0]
            model.p[name][at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-3


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = Q.op10_byte_gru_language(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    rows = [(1, "the and of", "en"), (2, None, "en"), (3, "123 !!", None), (4, "é" * 100000, "fr"), (None, "der die", "de"), (6, "", "de"), (1, "the and of", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = identify(df, steps=5).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (2, 3, 6)] == ["und"] * 3
    assert identify(df.where("false")).count() == 0
